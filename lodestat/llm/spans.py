"""Places of pattern matches in texts, by column expressions alone.

Places count code points, ends are exclusive. Patterns must match no empty
string. A pattern is scanned as Java's Matcher.find does: leftmost, not
overlapping. Spark gives matches and the texts between them but no places;
both lists together give them.
"""

from __future__ import annotations

SPAN = "array<struct<s:int,e:int,v:string>>"


def _scan(values: str, both: str = "{0} + {1}") -> str:
    """SQL for the running totals of an array of ints, or its running values by another sum of two: each turn reaches twice as far back."""
    turns = f"transform(filter(sequence(0, 30), j -> shiftleft(1, j) < size({values})), j -> shiftleft(1, j))"
    step = f"transform(a, (x, i) -> CASE WHEN i >= j THEN {both.format('a[i - j]', 'x')} ELSE x END)"
    return f"aggregate({turns}, cast({values} AS array<int>), (a, j) -> cast({step} AS array<int>))"


def found(text: str, p: str, group: int = 0) -> str:
    """SQL for the spans (s, e, v) of pattern p in the SQL expression text; v is the given group. Work is linear in the text, and n log n in its n matches."""
    empty = f"cast(array() AS {SPAN})"
    values = "m" if group == 0 else f"regexp_extract_all({text}, r\"{p}\", {group})"
    between = f"slice(split({text}, r\"{p}\", -1), 1, size(m))"
    sizes = f"zip_with({between}, m, (g, x) -> length(g) + length(x))"
    placed = f"zip_with(ends, zip_with(m, {values}, (w, v) -> named_struct('w', length(w), 'v', v)), (e, x) -> named_struct('s', e - x.w, 'e', e, 'v', x.v))"
    walk = f"transform(array({sizes}), z -> transform(array({_scan('z')}), ends -> {placed})[0])[0]"
    return f"transform(array(regexp_extract_all({text}, r\"{p}\", 0)), m -> CASE WHEN size(m) = 0 THEN {empty} ELSE cast({walk} AS {SPAN}) END)[0]"


def kinds(parts: dict[str, str], first: int = 0) -> str:
    """One array<struct<k,kind,s,e,v>> of the spans of several kinds, in the order of the kinds."""
    each = [f"transform({sql}, x -> named_struct('k', {first + i}, 'kind', '{kind}', 's', x.s, 'e', x.e, 'v', x.v))" for i, (kind, sql) in enumerate(parts.items())]
    return f"concat({', '.join(each)})"


def digest(spans: str) -> str:
    """kind:start:end, comma-joined, in the order of the array."""
    return f"array_join(transform({spans}, x -> concat(x.kind, ':', cast(x.s AS string), ':', cast(x.e AS string))), ',')"


def many(spans: str, kind: str) -> str:
    return f"cast(size(filter({spans}, x -> x.kind = '{kind}')) AS long)"


#: Code points of a block of text: substring() counts from a string's beginning, so long texts are cut into blocks once.
_BLOCK = 4_096


def replaced(text: str, spans: str, by: str) -> str:
    """text with by(x) in the place of spans; spans that overlap are one, from the first's start (at one start, the longest's) to the last end, of the first's kind. There must be one at least."""
    ordered = f"array_sort({spans}, (a, b) -> CASE WHEN a.s <> b.s THEN a.s - b.s ELSE b.e - a.e END)"
    ends = _scan("transform(o, x -> x.e)", "greatest({0}, {1})")
    firsts = "filter(sequence(0, size(o) - 1), i -> CASE WHEN i = 0 THEN true ELSE o[i].s >= h[i - 1] END)"
    whole = "transform(f, (i, n) -> named_struct('f', CASE WHEN i = 0 THEN 0 ELSE h[i - 1] END, 's', o[i].s, 'e', CASE WHEN n + 1 < size(f) THEN h[f[n + 1] - 1] ELSE h[size(o) - 1] END, 'kind', o[i].kind))"
    blocks = f"transform(sequence(0, length({text}) DIV {_BLOCK}), i -> substring({text}, i * {_BLOCK} + 1, {_BLOCK}))"

    def cut(first: str, end: str) -> str:
        one = f"substring(t[q], greatest({first} - q * {_BLOCK}, 0) + 1, least({end}, (q + 1) * {_BLOCK}) - greatest({first}, q * {_BLOCK}))"
        return f"CASE WHEN {first} >= {end} THEN '' ELSE array_join(transform(sequence({first} DIV {_BLOCK}, ({end} - 1) DIV {_BLOCK}), q -> {one}), '') END"

    joined = f"concat(array_join(transform(w, x -> concat({cut('x.f', 'x.s')}, {by})), ''), {cut('h[size(o) - 1]', f'length({text})')})"
    let = lambda name, value, rest: f"transform(array({value}), {name} -> {rest})[0]"
    return let("o", ordered, let("h", ends, let("f", firsts, let("w", whole, let("t", blocks, joined)))))
