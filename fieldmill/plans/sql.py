"""DuckDB expressions of the value rules, which read texts as they are: they know nothing of how a
query derived them. Functions take and give SQL text."""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

_NAMES = count()


def let(value: str, body: Callable[[str], str]) -> str:
    name = f"v{next(_NAMES)}"
    return f"list_transform([{value}], lambda {name}: {body(name)})[1]"


def number(text: str) -> str:
    """The number in a text."""

    def decimal(x: str) -> str:
        last = lambda sign: f"strpos(reverse({x}), '{sign}')"
        both = f"CASE WHEN {last(',')} < {last('.')} THEN replace(replace({x}, '.', ''), ',', '.') ELSE replace({x}, ',', '') END"
        lone = f"CASE WHEN len({x}) - len(replace({x}, ',', '')) = 1 AND {last(',')} <= 3 THEN replace({x}, ',', '.') ELSE replace({x}, ',', '') END"
        return f"CASE WHEN contains({x}, ',') AND contains({x}, '.') THEN {both} WHEN contains({x}, ',') THEN {lone} ELSE {x} END"

    def read(y: str) -> str:
        whole = f"CASE WHEN regexp_full_match({y}, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN try_cast({y} AS DOUBLE) END"
        return f"coalesce({whole}, try_cast(nullif(regexp_extract({y}, '-?[0-9]+\\.?[0-9]*'), '') AS DOUBLE))"

    bare = f"replace(replace(trim(regexp_replace(trim({text}), '[€$£¥%]', '', 'g')), ' ', ''), chr(160), '')"
    return let(let(bare, decimal), read)


def date(text: str) -> str:
    """The day-first date at the front of a text as year * 10000 + month * 100 + day."""

    def part(t: str, digits: int, group: int) -> str:
        return f"try_cast(nullif(regexp_extract(trim({t}), '^([0-9]{{1,2}})[/\\-.]([0-9]{{1,2}})[/\\-.]([0-9]{{{digits}}})', {group}), '') AS INT)"

    def read(t: str, digits: int) -> str:
        year = let(part(t, digits, 3), lambda y: f"CASE WHEN {y} < 50 THEN 2000 + {y} WHEN {y} < 100 THEN 1900 + {y} ELSE {y} END")
        day, month = part(t, digits, 1), part(t, digits, 2)
        return let(year, lambda y: f"CASE WHEN {day} BETWEEN 1 AND 31 AND {month} BETWEEN 1 AND 12 AND {y} BETWEEN 1900 AND 2100 THEN {y} * 10000 + {month} * 100 + {day} END")

    return let(text, lambda t: f"coalesce({read(t, 4)}, {read(t, 2)})")


def near(a: str, b: str) -> str:
    return let(number(a), lambda x: let(number(b), lambda y: f"coalesce({x} = {y} OR CASE WHEN {x} <> 0 THEN abs({x} - {y}) / abs({x}) < 0.001 ELSE abs({y}) < 0.001 END, false)"))


def empty(text: str) -> str:
    return f"coalesce(trim({text}, ' ' || chr(9) || chr(10)) IN ('', 'null', 'None'), true)"


def plain(text: str) -> str:
    """The normal form of a string: compatibility forms resolved, marks and all beyond ASCII dropped."""
    folded = f"regexp_replace(strip_accents(lower(trim(nfc_normalize({text})))), '[^\\x00-\\x7f]', '', 'g')"
    return f"regexp_replace({folded}, '\\s+', ' ', 'g')"


def key(text: str) -> str:
    return f"regexp_replace(strip_accents(lower({text})), '[^a-z0-9]', '', 'g')"


def verdict(a: str, b: str) -> str:
    """How two texts match, mismatch if they don't; without fuzzy matches."""

    def of(x: str, y: str) -> str:
        shaped = lambda t: f"regexp_full_match(trim({t}), '[0-9]{{1,2}}[/\\-.][0-9]{{1,2}}[/\\-.][0-9]{{2,4}}')"
        numeric = lambda t: f"regexp_full_match(regexp_replace(trim({t}), '[€$£¥%\\s]', '', 'g'), '-?[0-9.,]+')"
        return f"""CASE WHEN {empty(x)} AND {empty(y)} THEN 'normalized' WHEN {empty(x)} OR {empty(y)} THEN 'mismatch'
 WHEN ({shaped(x)} OR {shaped(y)}) AND coalesce({date(x)} = {date(y)}, false) THEN 'date' WHEN ({numeric(x)} OR {numeric(y)}) AND {near(x, y)} THEN 'numeric'
 WHEN trim({x}) = trim({y}) THEN 'exact' WHEN {plain(x)} = {plain(y)} THEN 'normalized' ELSE 'mismatch' END"""

    return let(a, lambda x: let(b, lambda y: of(x, y)))


def candidate(text: str) -> str:
    """The part of an output that should be a JSON object."""

    def braces(t: str) -> str:
        fence = f"regexp_extract({t}, '(?s)```(?:json)?\\s*(\\{{.*?\\}})\\s*```', 1)"
        return f"CASE WHEN {fence} <> '' THEN trim({fence}) WHEN regexp_matches({t}, '(?s)\\{{.*\\}}') THEN regexp_extract({t}, '(?s)\\{{.*\\}}') ELSE {t} END"

    def thought(t: str) -> str:
        return f"trim(CASE WHEN contains({t}, '</think>') THEN substr({t}, strpos({t}, '</think>') + 8) ELSE {t} END)"

    return let(let(f"coalesce({text}, '')", thought), braces)


def repaired(text: str) -> str:
    """Commas before closing brackets dropped, an open quote closed, missing brackets added."""

    def lacking(t: str, a: str, b: str) -> str:
        return f"(len(replace({t}, '{b}', '')) - len(replace({t}, '{a}', '')))"

    commas = f"regexp_replace(regexp_replace(trim({text}), ',\\s*\\}}', '}}', 'g'), ',\\s*\\]', ']', 'g')"
    quotes = lambda t: f"CASE WHEN (len({t}) - len(replace({t}, '\"', '')) - (len({t}) - len(replace({t}, chr(92) || '\"', ''))) / 2) % 2 = 1 THEN {t} || '\"' ELSE {t} END"
    swap = lambda t: f"CASE WHEN {lacking(t, '[', ']')} < 0 AND {lacking(t, '{', '}')} > 0 AND ends_with({t}, ']') THEN left({t}, -1) || '}}' ELSE {t} END"
    close = lambda t: f"{t} || repeat(']', greatest({lacking(t, '[', ']')}, 0)::INT) || repeat('}}', greatest({lacking(t, '{', '}')}, 0)::INT)"
    return let(let(let(commas, quotes), swap), close)


def strict(text: str) -> str:
    """Whether a text is strict JSON (DuckDB lets commas before closing brackets pass)."""
    return f"(json_valid({text}) AND NOT regexp_matches({text}, ',\\s*[}}\\]]'))"


def scores(source: str, keys: str) -> str:
    """CTEs from a query source (keys, gt, pred) up to v: a row a field with keys, ok; and j: a row a
    record with keys, gok, obj."""
    return f"""r AS ({source}), c AS (SELECT *, {candidate('pred')} AS cand FROM r), x AS (SELECT *, {repaired('cand')} AS fixed FROM c),
j AS (SELECT *, CASE WHEN {strict('gt')} THEN json_type(gt) = 'OBJECT' ELSE false END AS gok,
  CASE WHEN {strict('cand')} THEN CASE WHEN json_type(cand) = 'OBJECT' THEN cand END WHEN json_valid(fixed) THEN CASE WHEN json_type(fixed) = 'OBJECT' THEN fixed END END AS obj FROM x),
k AS (SELECT {keys}, gt, obj, unnest(json_keys(gt)) AS key FROM j WHERE gok),
p AS (SELECT *, list_filter(json_keys(obj), lambda q: {key('q')} = {key('key')})[1] AS pk FROM k),
w AS (SELECT *, json_extract_string(gt, '$."' || key || '"') AS a, json_extract_string(obj, '$."' || pk || '"') AS b FROM p),
v AS (SELECT {keys}, key, a, b, obj, pk, CASE WHEN obj IS NULL THEN 'mismatch' WHEN pk IS NULL THEN CASE WHEN {empty('a')} THEN 'missing_ok' ELSE 'mismatch' END ELSE {verdict('a', 'b')} END AS kind FROM w)"""


def gestalt(rows: str) -> str:
    """CTEs (after WITH RECURSIVE) from rows (id, a, b): likeness (id, ratio), twice the letters in common
    blocks over all letters. The longest common block comes first, of these the first in a, then the
    first in b; then what stands on its left in both, and on its right."""
    block = "list_transform(range(length(a)), lambda i: list_transform(range(1, length(a) - i + 1), lambda k: CASE WHEN contains(b, a[i + 1 : i + k]) THEN k * 100000 - i ELSE 0 END))"
    cut = f"SELECT id, a, b, best, (best + 99999) // 100000 AS k, (100000 - best % 100000) % 100000 AS i FROM (SELECT id, a, b, coalesce(list_max(flatten({block})), 0) AS best FROM {{}})"
    return f"""gs_rows AS (SELECT * FROM ({rows})),
gs_parts(id, a, b) AS (
  SELECT id, a, b FROM gs_rows UNION ALL
  SELECT id, unnest([a[1 : i], a[i + k + 1 :]]), unnest([b[1 : j], b[j + k + 1 :]]) FROM (SELECT *, strpos(b, a[i + 1 : i + k]) - 1 AS j FROM ({cut.format("gs_parts WHERE a <> '' AND b <> ''")})) WHERE k > 0),
gs_blocks AS (SELECT id, k FROM ({cut.format("gs_parts")})),
likeness AS (SELECT g.id, CASE WHEN length(a) + length(b) = 0 THEN 1.0 ELSE 2.0 * sum(k) / (length(a) + length(b)) END AS ratio FROM gs_blocks JOIN gs_rows g USING (id) GROUP BY g.id, a, b)"""
