"""Column functions over lines of text; all stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space by Unicode's definition, for use inside a regex class.
WS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

# What the line filters recognise.
SPINNERS = ("⠋", "⠙", "⠹", "⠸", "⠼", "⠴", "⠦", "⠧", "⠇", "⠏")
NPM_NOISE = ("npm warn deprecated", "WARN deprecated", "npm notice", "npm warn EBADENGINE")
BUNDLER_NOISE = (
    "[tsconfig-paths]",
    'The plugin "vite-tsconfig-paths"',
    'The plugin "@vitejs/plugin-react"',
    "Vite now supports tsconfig paths resolution natively",
    "You can remove the plugin and set resolve.tsconfigPaths",
    "For new projects, use create-next-app to choose",
    "`next lint` is deprecated",
)
ERROR_MARKERS = (
    "error:", "Error:", "ERROR:", "error[", "Error[", "panic", "Panic", "PANIC", "fatal:", "Fatal:", "FATAL:",
    "failed", "Failed", "FAILED", "Traceback", "traceback", "Exception", "exception",
)
ERROR_STARTS = ("error:", "Error:", "error[", "FAILED", "fatal:", "panic:")


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def literal(text: str) -> str:
    """A pattern for the text itself."""
    return "".join(f"\\{x}" if x in "\\.[]{}()*+-?^$|&" else x for x in text)


def alternation(parts: tuple[str, ...]) -> str:
    return "(?:" + "|".join(literal(p) for p in parts) + ")"


# one pattern instead of many tests: the optimizer copies a column's expression into each test that refers to it
def starts_any(c: Column, prefixes: tuple[str, ...]) -> Column:
    return c.rlike(f"\\A{alternation(prefixes)}")


def has_any(c: Column, parts: tuple[str, ...]) -> Column:
    return c.rlike(alternation(parts))


def ltrim(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{WS}]+", "")


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{WS}]+|[{WS}]+$", "")


def lines(text: Column) -> Column:
    """Lines of a text: ended by LF or CRLF, the last one with or without an end. Empty and null texts have none."""
    body = F.split(F.regexp_replace(text, "\r?\n\\z", ""), "\r?\n", -1)
    return F.when(F.length(text) > 0, body).otherwise(F.array().cast("array<string>"))


def tokens(c: Column) -> Column:
    """Parts between runs of white space."""
    return F.filter(F.split(c, f"[{WS}]+"), lambda t: t != "")


def strip_ansi(c: Column) -> Column:
    """Without escape sequences: from ESC [ to the first ASCII letter, or to the end."""
    return F.regexp_replace(c, "\x1b\\[[^A-Za-z]*(?:[A-Za-z]|\\z)", "")


def strip_timestamp(c: Column) -> Column:
    """Without a leading ``[stamp] `` that looks like a date or time."""
    end = F.instr(c, "] ")
    stamp = F.substring(c, F.lit(2), end - 2)
    dated = F.contains(stamp, F.lit("-")) & (F.contains(stamp, F.lit("T")) | F.contains(stamp, F.lit(":")))
    return F.when(c.startswith("[") & (end > 0) & dated, F.substring(c, end + 2, F.length(c))).otherwise(c)


def is_blank(c: Column) -> Column:
    return trim(c) == ""


def is_spinner(c: Column) -> Column:
    return starts_any(ltrim(c), SPINNERS)


def is_progress(c: Column) -> Column:
    t = trim(c)
    bar = reduce(lambda a, b: a & b, [F.contains(t, F.lit(x)) for x in "[]=>"])
    return has_any(t, ("█", "░")) | bar | (t.endswith("%") & t.rlike("[0-9]"))


def is_module_frame(c: Column) -> Column:
    return F.contains(c, F.lit("node_modules/")) & (ltrim(c).startswith("at ") | F.contains(c, F.lit("(/.")))


#: Blank lines, spinners, hints, package manager and bundler noise; progress bars; frames of dependencies.
NOISE = "|".join((
    f"\\A[{WS}]*(?:\\z|hint:|{alternation(SPINNERS + NPM_NOISE + BUNDLER_NOISE)})",
    "[█░]",
    "\\A(?=.*\\[)(?=.*\\])(?=.*=)(?=.*>)",
    f"[0-9].*%[{WS}]*\\z",
    f"\\A(?=.*node_modules/)(?:[{WS}]*at |.*\\(/\\.)",
))


def is_noise(c: Column) -> Column:
    return c.rlike(f"(?s){NOISE}")


def has_error_marker(c: Column) -> Column:
    return has_any(c, ERROR_MARKERS)


def looks_like_path(c: Column) -> Column:
    size = F.octet_length(c)
    return (
        F.contains(c, F.lit("/")) & F.contains(c, F.lit(".")) & ~c.startswith("http") & ~c.startswith("//")
        & (size > 4) & (size < 160) & c.rlike("^[\\p{L}\\p{N}/_.:-]+$")
    )


def paths(text: Column, most: int = 100) -> Column:
    """The first distinct tokens that look like paths, without the punctuation around them."""
    bare = F.transform(tokens(text), lambda t: F.regexp_replace(t, "^[,:()'\"]+|[,:()'\"]+$", ""))
    return F.slice(F.array_distinct(F.filter(bare, looks_like_path)), 1, most)


def normalize_error(c: Column) -> Column:
    """An error's shape: paths, hex runs and numbers replaced by names; 200 characters at most."""
    low = F.lower(trim(c))
    shaped = F.regexp_replace(F.regexp_replace(F.regexp_replace(low, f'/[^{WS}"]+', "PATH"), "[a-f][0-9a-f]{5,}", "HEX"), "[0-9]+", "N")
    return F.left(shaped, F.lit(200))


def command_name(c: Column) -> Column:
    """The program of a command: after assignments and runners, without its folder, in lower case."""
    bare = F.regexp_replace(trim(c), f"^(?:[^{WS}]*=[^{WS}]*[{WS}]+)+", "")
    bare = F.regexp_replace(bare, "^(?:npx )?(?:bunx )?(?:pnpm exec )?(?:yarn exec )?", "")
    first = F.regexp_extract(bare, f"^[{WS}]*([^{WS}]*)", 1)
    return F.lower(F.regexp_extract(first, "([^/]*)$", 1))


def tokens_by_bytes(c: Column) -> Column:
    return (F.octet_length(c).cast("long") / 4).cast("long")


def reduction_pct(before: Column, after: Column) -> Column:
    """Whole per cent saved, 0 for an empty input."""
    return F.when(before > 0, F.greatest(F.lit(0), F.lit(100) - F.floor(after * 100 / before))).otherwise(0).cast("long")


def fnv1a(c: Column) -> Column:
    """FNV-1a of a string's bytes as 16 hex digits; meant for short strings.

    The 64-bit state is kept as two 32-bit halves, since products must not overflow. The prime is 2**40 + 435.
    """
    mask = 0xFFFFFFFF
    octets = F.transform(F.sequence(F.lit(1), F.octet_length(c)), lambda i: F.conv(F.hex(F.substring(c.cast("binary"), i, F.lit(1))), 16, 10).cast("long"))
    octets = F.when(F.octet_length(c) > 0, octets).otherwise(F.array().cast("array<bigint>"))
    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo"))

    def step(s: Column, b: Column) -> Column:
        x = s["lo"].bitwiseXOR(b)
        low = x * 435
        high = s["hi"] * 435 + F.shiftright(low, 32) + F.shiftleft(x, 8)
        return F.struct(high.bitwiseAND(F.lit(mask)).alias("hi"), low.bitwiseAND(F.lit(mask)).alias("lo"))

    end = F.aggregate(octets, start, step)
    return F.concat(F.lpad(F.lower(F.hex(end["hi"])), 8, "0"), F.lpad(F.lower(F.hex(end["lo"])), 8, "0"))


def trigrams(text: Column) -> Column:
    """Distinct runs of three tokens, joined by one space; none for fewer tokens.

    Shifted copies of the tokens are zipped, so that they are made three times and not once for each run.
    """
    t = tokens(text)
    rest = lambda k: F.slice(t, k, F.greatest(F.size(t), F.lit(1)))
    glue = lambda a, b: F.concat(a, F.lit(" "), b)
    runs = F.zip_with(F.zip_with(t, rest(2), glue), rest(3), glue)
    return F.array_distinct(F.filter(runs, lambda r: r.isNotNull()))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two sets as a 32-bit number; 0 if one is empty."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), (both.cast("float") / either.cast("float")).cast("float")).otherwise(F.lit(0.0).cast("float"))
