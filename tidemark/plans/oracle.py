"""DuckDB SQL for line operators, stated independently of the Spark plans."""

from __future__ import annotations

from tidemark.plans.stated import BUNDLER_NOISE, NPM_NOISE, SPINNERS

WS = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def ltrim(c: str) -> str:
    return f"regexp_replace({c}, '^[{WS}]+', '')"


def trim(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^[{WS}]+', ''), '[{WS}]+$', '')"


def starts(c: str, prefixes) -> str:
    return "(" + " or ".join(f"starts_with({c}, {quoted(p)})" for p in prefixes) + ")"


def has(c: str, parts) -> str:
    return "(" + " or ".join(f"contains({c}, {quoted(p)})" for p in parts) + ")"


#: (doc_id, n, line) of documents.
DOCUMENT_LINES = r"""
select doc_id as k, i as n, ls[i] as line
from (select doc_id, string_split_regex(regexp_replace(text, '\r?\n\z', ''), '\r?\n') as ls from documents where length(text) > 0), unnest(range(1, len(ls) + 1)) as t(i)
"""


def clean(source: str) -> str:
    """Cleaned lines of the relation ``source`` (k, n, line)."""
    bar = "contains(t, '[') and contains(t, ']') and contains(t, '=') and contains(t, '>')"
    return f"""
    select k, n, case when starts_with(line, '[') and position('] ' in line) > 0 and contains(line[2:position('] ' in line) - 1], '-')
        and (contains(line[2:position('] ' in line) - 1], 'T') or contains(line[2:position('] ' in line) - 1], ':')) then line[position('] ' in line) + 2:] else line end as line
    from (select k, n, line, {trim('line')} as t, {ltrim('line')} as h from (
      select k, n, replace(regexp_replace(line, chr(27) || '\\[[^A-Za-z]*([A-Za-z]|\\z)', '', 'g'), chr(13), '') as line from ({source})))
    where t <> '' and not {starts('h', SPINNERS)}
      and not (contains(t, '█') or contains(t, '░') or ({bar}) or (ends_with(t, '%') and regexp_matches(t, '[0-9]')))
      and not starts_with(h, 'hint:') and not {starts('h', NPM_NOISE)} and not {starts('h', BUNDLER_NOISE)}
      and not (contains(line, 'node_modules/') and (starts_with(h, 'at ') or contains(line, '(/.')))
    """.replace("\\\\", "\\")


def where(source: str, condition: str) -> str:
    return f"select k, n, line from (select *, {trim('line')} as t, {ltrim('line')} as h from ({source})) where {condition}"


def dedup(source: str, least: int) -> str:
    return f"""
    select k, n, case when c >= {least} then line || '  [×' || c || ']' else line end as line
    from (select *, count(*) over (partition by k, line) as c, min(n) over (partition by k, line) as f from ({source})) where c < {least} or n = f
    """


def group(source: str, least: int) -> str:
    return f"""
    select k, n, case when c >= {least} then g || '/  ' || c || ' modified  [grouped]' else line end as line
    from (select *, count(*) over (partition by k, g) as c, min(n) over (partition by k, g) as f from (
      select *, prefix || case when contains(path, '/') then regexp_extract(path, '(?s)^(.*)/', 1) else '.' end as g from (
        select *, case when position(':' in h) > 0 then h[:position(':' in h)] else '' end as prefix,
          case when position(':' in h) > 0 then {trim("h[position(':' in h) + 1:]")} else line end as path
        from (select *, {ltrim('line')} as h from ({source})))))
    where c < {least} or n = f
    """


def hits(source: str, least: int = 5) -> str:
    return f"""
    select k, n, case when file is not null and c >= {least} then file || ': ' || c || ' matches [collapsed]' else line end as line
    from (select *, count(*) over (partition by k, file) as c, min(n) over (partition by k, file) as f from (
      select *, case when {trim('line')} <> '' and not starts_with(line, 'Binary file') and contains(line, ':') and (contains(split_part(line, ':', 1), '.') or contains(split_part(line, ':', 1), '/'))
        then split_part(line, ':', 1) end as file from ({source})))
    where file is null or c < {least} or n = f
    """


def truncate(source: str, limit: int, tail: bool) -> str:
    inside, edge = (f"r > a - {limit}", f"r = a - {limit}") if tail else (f"r <= {limit}", f"r = {limit} + 1")
    return f"""
    select k, n, case when a > {limit} and {edge} then '[... ' || (a - {limit}) || ' lines truncated]' else line end as line
    from (select *, row_number() over (partition by k order by n) as r, count(*) over (partition by k) as a from ({source})) where a <= {limit} or {inside} or {edge}
    """
