"""Prose compression of markdown-like text: phrases, fillers and articles go; code, links, tables and headings stay."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import text as X


@dataclass(frozen=True)
class Locale:
    fillers: tuple[str, ...]
    articles: tuple[str, ...]
    phrases: tuple[str, ...]
    hedges: tuple[str, ...]
    conjunctions: tuple[str, ...]
    substitutions: tuple[tuple[str, str], ...]


# Word lists by language.
LOCALES = {
    "en": Locale(
        fillers=("just", "really", "basically", "actually", "simply", "sure", "certainly"),
        articles=("the", "a", "an"),
        phrases=("of course", "i'd be happy to", "let me ", "i'll help you", "i would like to", "please note that", "it might be worth", "you could consider", "in general", "as a rule"),
        hedges=("perhaps", "maybe"),
        conjunctions=(" and", " or", " but", " so"),
        substitutions=(
            ("without", "w/o"), ("with", "w/"), ("because", "b/c"), ("function", "fn"), ("parameter", "param"), ("arguments", "args"), ("argument", "arg"),
            ("configuration", "config"), ("documentation", "docs"), ("directory", "dir"), ("repository", "repo"), ("between", "btw"), ("versus", "vs"), ("approximately", "~"),
        ),
    ),
    "pt-BR": Locale(
        fillers=("só", "apenas", "realmente", "basicamente", "literalmente", "simplesmente", "certamente", "claramente", "obviamente", "exatamente", "praticamente", "tipo", "meio"),
        articles=("o", "a", "os", "as", "um", "uma", "uns", "umas", "do", "da", "dos", "das", "no", "na", "nos", "nas", "ao", "aos", "à", "às", "pelo", "pela", "pelos", "pelas"),
        phrases=(
            "claro que sim", "com certeza", "fico feliz em ajudar", "ficarei feliz em", "deixa eu ", "deixe-me ", "vou te ajudar", "gostaria de ", "por favor, note que", "vale a pena ",
            "você pode considerar que", "você pode considerar", "de modo geral", "em geral", "como regra", "é importante notar que", "vale ressaltar que", "vale lembrar que",
        ),
        hedges=("talvez", "possivelmente", "provavelmente", "eventualmente", "porventura", "quiçá"),
        conjunctions=(" e", " ou", " mas", " porém", " contudo", " então", " logo", " pois"),
        substitutions=(
            ("sem", "s/"), ("com", "c/"), ("porque", "pq"), ("por que", "pq"), ("função", "fn"), ("funções", "fns"), ("parâmetro", "param"), ("parâmetros", "params"), ("argumento", "arg"),
            ("argumentos", "args"), ("configuração", "config"), ("configurações", "configs"), ("documentação", "docs"), ("diretório", "dir"), ("repositório", "repo"), ("aproximadamente", "~"),
            ("também", "tb"), ("você", "vc"), ("para", "p/"),
        ),
    ),
}

_KEPT = re.compile(r"`[^`]*`?|https?://[^\s)\]\">]*")
_MARKER = re.compile(r"(\s*)([-*+] |[0-9]+[.)] )?(.*)", re.S)
_WORD = re.compile(r"(\s*)(\S+)")
_CLEAN = re.compile(r"[^\W_]['\w]*(?<!_)[,.;:!?]*|'['\w]*[,.;:!?]*")


def _span_rules(locale: Locale, ultra: bool) -> Callable[[str], str]:
    """What happens to a stretch of prose between code and links."""
    phrases = [(p, re.compile(re.escape(p) + " *", re.I)) for p in locale.phrases]
    gone = {*locale.fillers, *locale.articles, *locale.hedges}
    last = re.compile(r"(?:" + "|".join(map(re.escape, locale.conjunctions)) + r")\Z", re.I)
    short = [(a, re.compile(rf"(?<!\w){re.escape(a)}(?!\w)", re.I), b) for a, b in locale.substitutions]

    def droppable(word: str) -> bool:
        return word.rstrip(",.;:!?").lower() in gone and "_" not in word and bool(_CLEAN.fullmatch(word))

    def run(span: str) -> str:
        if not span.strip():
            return span
        text = span
        low = text.lower()
        for phrase, pattern in phrases:
            if phrase in low:
                text = pattern.sub("", text)
                low = text.lower()
        # a dropped word takes the white space before it along
        kept = [(" " if gap else "") + word for gap, word in _WORD.findall(text) if not droppable(word)]
        text = "".join(kept)
        text = last.sub("", text).rstrip() if last.search(text) else text
        lead = text[: len(text) - len(text.lstrip())]
        text = lead + text.lstrip().lstrip(",;: ").lstrip()
        text = re.sub(r"([.!?] )[,;] *| [,;] ", lambda m: m[1] or " ", text)
        if ultra:
            low = text.lower()
            for long, pattern, instead in short:
                if long in low:
                    text = pattern.sub(instead, text)
                    low = text.lower()
        if span.startswith(" ") and not text.startswith(" "):
            text = " " + text
        return text + " " if span.endswith(" ") and not text.endswith(" ") else text

    return run


def line_compressor(locale: Locale, ultra: bool) -> Callable[[str], str]:
    prose = _span_rules(locale, ultra)

    def run(line: str) -> str:
        lead, marker, rest = _MARKER.fullmatch(line).groups()
        parts, at = [], 0
        for m in _KEPT.finditer(rest):
            parts += [prose(rest[at : m.start()]) if m.start() > at else "", m[0]]
            at = m.end()
        parts.append(prose(rest[at:]) if at < len(rest) else "")
        return (lead + (marker or "") + "".join(parts)).rstrip(" \t")

    return run


_TABLE = re.compile(r"\s*\|.*\|.*", re.S)
_PROTECTED = re.compile(r"\s*(?:\Z|#|<!--|>|---|===)")


def compress_text(text: str, locale: Locale, ultra: bool = False) -> str:
    """A text line by line, and then with one empty line for each run of blank ones."""
    line_of, fenced, lines = line_compressor(locale, ultra), False, []
    for line in text.split("\n"):
        fence = line.lstrip().startswith("```")
        if fenced or fence or _TABLE.fullmatch(line) or _PROTECTED.match(line):
            lines.append(line)
            fenced ^= fence
        else:
            lines.append(line_of(line))
    out: list[str] = []
    for line in lines:
        if line.strip():
            out.append(line)
        elif not out or out[-1]:
            out.append("")
    return "\n".join(out)


def compressed(text: Column, locale: str = "en", ultra: bool = False) -> Column:
    """Arrow batches of whole texts: what a line becomes depends on the fences before it."""
    words = LOCALES[locale]

    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: None if t is None else compress_text(t, words, ultra))

    return F.pandas_udf(run, "string", F.PandasUDFType.SCALAR)(text)


def fences(text: Column) -> Column:
    return F.expr("0") + F.floor(F.size(F.filter(X.lines(text), lambda line: X.ltrim(line).startswith("```"))) / 2).cast("int")


def links(text: Column) -> Column:
    # a link's text belongs to it, whatever it holds
    return F.regexp_count(text, F.lit(f'https?://[^{X.WS})\\]"]*'))


def headings(text: Column) -> Column:
    return F.size(F.filter(X.lines(text), lambda line: X.ltrim(line).startswith("#")))


def is_safe(before: Column, after: Column) -> Column:
    """Same fences and headings, no link lost, and a fifth of the bytes left at least."""
    return (fences(before) == fences(after)) & (links(after) >= links(before)) & (headings(before) == headings(after)) & (F.octet_length(after) * 5 >= F.octet_length(before))


def fence_state(lines: DataFrame, key: str) -> DataFrame:
    """``lines`` with kind: fence, code, table, protected or prose."""
    fence = X.ltrim(F.col("line")).startswith("```")
    before = F.coalesce(F.sum(fence.cast("int")).over(Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bare = X.trim(F.col("line"))
    protected = (bare == "") | bare.rlike("^(?:#|<!--|>|---|===)")
    kind = F.when(fence, "fence").when(before % 2 == 1, "code").when(bare.rlike("(?s)^\\|.*\\|"), "table").when(protected, "protected").otherwise("prose")
    return lines.withColumn("kind", kind)


def collapse_blank(lines: DataFrame, key: str) -> DataFrame:
    """Of each run of blank lines the first stays, empty."""
    blank = X.is_blank(F.col("line"))
    again = F.coalesce(F.lag(blank).over(Window.partitionBy(key).orderBy("n")), F.lit(False))
    return lines.withColumn("_again", blank & again).where("not _again").drop("_again").withColumn("line", F.when(blank, "").otherwise(F.col("line")))


def safely_compressed(rows: DataFrame, text: str, locale: str = "en", ultra: bool = False) -> DataFrame:
    """``rows`` with out, the compressed text where that is safe and else the text itself, and safe. The text stays as it was."""
    made = rows.withColumn("_out", compressed(F.col(text), locale, ultra)).withColumn("safe", F.explode(F.array(is_safe(F.col(text), F.col("_out")))))
    return made.withColumn("out", F.when(F.col("safe"), F.col("_out")).otherwise(F.col(text))).drop("_out")


def cut_to(text: Column, most_tokens: int, notice: str = "\n[... cut]") -> Column:
    """Texts over the budget in characters / 4 are cut to fit it with a notice."""
    return F.when(F.floor(F.char_length(text) / 4) > most_tokens, F.concat(F.left(text, F.lit(most_tokens * 4 - len(notice))), F.lit(notice))).otherwise(text)


def prompt_budget(rows: DataFrame, text: str, most_tokens: int = 2000, locale: str = "en") -> DataFrame:
    """``rows`` with the text brought into a budget: as it is if it fits, else compressed in full, else that cut with a notice.

    No budget, 0, leaves all as they are. Only texts over the budget are compressed.
    """
    if not most_tokens:
        return rows
    over = F.floor(F.char_length(text) / 4) > most_tokens
    large = safely_compressed(rows.where(over), text, locale, ultra=True)
    fitted = large.withColumn(text, cut_to(F.col("out"), most_tokens)).select(rows.columns)
    return rows.where(~F.coalesce(over, F.lit(False))).unionByName(fitted)


def replaced_prompt(before: Column, after: Column) -> Column:
    """A prompt's compressed form if there is one and it is shorter."""
    return F.when((F.length(after) > 0) & (F.length(after) < F.length(before)), after).otherwise(before)


def memory_warning(text: Column, name: Column, most_tokens: int, start: str = "<!-- tidemark:start -->", end: str = "<!-- tidemark:end -->") -> Column:
    """What to say of a notes file of over ``most_tokens`` bytes / 4, less a block of ours at its begin; null of others or without a limit."""
    if not most_tokens:
        return F.lit(None).cast("string")
    at = F.instr(text, end)
    rest = F.regexp_replace(F.substring(text, at + len(end), F.length(text)), "\\A\n", "")
    own = F.when(text.startswith(start) & (at > 0), rest).otherwise(text)
    size = F.floor(F.octet_length(own) / 4)
    return F.when(size > most_tokens, F.concat(name, F.lit(" is ~"), size.cast("string"), F.lit(f" tokens (> {most_tokens} recommended)")))
