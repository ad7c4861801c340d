"""Secret scans in DataFrame functions alone.

Three base patterns give spans; where a candidate string that no base span
touches has a window of high Shannon entropy for its character class, it is a
span too, unless an allow-list pattern suppresses it. A table of counts, one
place for each character, goes along the string: the character that leaves the
window and the one that enters change a place each, and the sum of n log n
with them.

Positions are code points, ends exclusive; ``split`` and ``regexp_extract_all``
over one pattern give the gaps and the matches, and running sums of their
lengths (blocks of blocks, so linear in the number of matches) the positions.

Defined results: a null or empty text has no spans; a null doc_id passes
through; text of any length is scanned whole; repeated rows give repeated
results; an empty table gives no rows; further columns are ignored by
:func:`scan` and passed on by :func:`redact`.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh_prefix

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: For maximal runs, a least length in the pattern drops just what a later filter would.
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
#: class: (characters, window, least bits); the first class that holds a candidate counts.
CLASSES = {"hex": ("[0-9A-Fa-f]+", 20, 3.0), "alnum": ("[A-Za-z0-9]+", 20, 3.7), "base64": ("[A-Za-z0-9+/_=-]+", 20, 3.8)}
#: Candidates that are no secrets: samples, UUIDs, hyphenated or dotted words, digests' labels, repeats.
ALLOWED = r"(?i)example|sample|placeholder|changeme|^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$|^sha(1|256|384|512)-|^[a-z]+([-_/=+][a-z]+)*$|^[-_=+/0-9]+$|(.)\2{7}"

SPAN = "array<struct<start:int,kind:int,end:int>>"


_BLOCK, _CUT = 32, 256


def with_running(rows: DataFrame, names: list[str], merge: str) -> DataFrame:
    """For each array column ``x`` of ``names``, ``x_run``: what ``merge`` (of a and b) makes of all values before each one, from 0.

    Blocks are merged, then blocks of blocks; only the last level's few values
    are gathered one by one, so the work is linear. Columns read inside a
    lambda are named twice: what is named once could be computed anew there
    for every element.
    """
    fold = lambda v, zero: f"aggregate({v}, {zero}, (a, b) -> {merge})"
    blocks = lambda v: f"if(size({v}) = 0, {v}, transform(sequence(0, (size({v}) - 1) div {_BLOCK}), k -> {fold(f'slice({v}, cast(k * {_BLOCK} + 1 as int), {_BLOCK})', '0')}))"
    inside = lambda v, up: f"if(size({up}) >= 0, transform({v}, (x, i) -> {fold(f'slice({v}, i - i % {_BLOCK} + 1, i % {_BLOCK})', f'{up}[cast(i div {_BLOCK} as int)]')}), {v})"
    last = lambda v: f"aggregate({v}, struct(0 AS a, cast(array() AS array<int>) AS out), (s, b) -> struct({re.sub(r"\ba\b", "s.a", merge)} AS a, concat(s.out, array(s.a)) AS out)).out"
    rows = rows.withColumns({f"{x}_1": F.expr(blocks(x)) for x in names})
    rows = rows.withColumns({f"{x}_2": F.expr(blocks(f"{x}_1")) for x in names})
    rows = rows.withColumns({f"{x}_3": F.expr(last(f"{x}_2")) for x in names})
    rows = rows.withColumns({f"{x}_4": F.expr(inside(f"{x}_1", f"{x}_3")) for x in names})
    return rows.withColumns({f"{x}_run": F.expr(inside(x, f"{x}_4")) for x in names})


def _matches(text: Column, pattern: str, second: bool) -> Column:
    """(gap before, match, second group) of the leftmost non-overlapping matches."""
    group = lambda k: F.regexp_extract_all(text, F.lit(pattern), F.lit(k))
    gaps = F.split(text, pattern, -1)
    rows = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(gaps) - 1).alias("gap"), group(0).alias("hit"), (group(2) if second else group(0)).alias("second"))
    return F.when(text.rlike(pattern), rows).otherwise(F.array().cast("array<struct<gap:string,hit:string,second:string>>"))


#: Candidates hold characters from 43 to 122 alone; a count is kept as the character 48 places on.
_FIRST_CODE, _PLACES, _ZERO = 43, 80, 48


def peak_entropy(word: Column, window: int) -> Column:
    """Greatest Shannon entropy (bits) of a window of ``word``, a candidate string; 0 if it is shorter."""
    table = F.array(*(F.lit(n * math.log2(n) if n else 0.0) for n in range(window + 2)))
    term = lambda n: F.element_at(table, n + 1)
    place = lambda c: F.ascii(c) - (_FIRST_CODE - 1)
    count = lambda counts, c: F.ascii(F.substring(counts, place(c), F.lit(1))) - _ZERO
    put = lambda counts, c, n: F.overlay(counts, F.char(n + _ZERO), place(c), F.lit(1))

    def step(acc: Column, x: Column) -> Column:
        enters, leaves = x["enters"], x["leaves"]
        n_out = count(acc["counts"], leaves)
        counts = F.when(leaves.isNull(), acc["counts"]).otherwise(put(acc["counts"], leaves, n_out - 1))
        less = F.when(leaves.isNull(), acc["sum"]).otherwise(acc["sum"] - term(n_out) + term(n_out - 1))
        n = count(counts, enters)
        total = less - term(n) + term(n + 1)
        best = F.when(acc["n"] >= window - 1, F.greatest(acc["best"], F.lit(math.log2(window)) - total / window)).otherwise(acc["best"])
        moved = F.struct(put(counts, enters, n + 1).alias("counts"), total.alias("sum"), best.alias("best"), (acc["n"] + 1).alias("n"))
        return F.when(enters.isNull(), acc).otherwise(moved)

    chars = F.split(word, "")
    late = F.concat(F.array_repeat(F.lit(None).cast("string"), window), chars)
    moves = F.zip_with(chars, late, lambda c, old: F.struct(c.alias("enters"), old.alias("leaves")))
    first = F.struct(F.lit(chr(_ZERO) * _PLACES).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"), F.lit(0).alias("n"))
    return F.aggregate(moves, first, step)["best"]


def _is_secret(word: Column) -> Column:
    by_class = None
    for chars, window, bits in CLASSES.values():
        test, high = word.rlike(f"^{chars}$"), peak_entropy(word, window) >= bits - 1e-9
        by_class = F.when(test, high) if by_class is None else by_class.when(test, high)
    return by_class.otherwise(False)


def _plausible(word: Column) -> Column:
    return word.rlike("[0-9]") & word.rlike("[A-Za-z]") & ~word.rlike(ALLOWED)


def _touches(span: Column, base: Column) -> Column:
    """Whether one of ``base`` (disjoint spans in order) overlaps the span: bisection for the first that ends after its start."""

    def step(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        left = F.get(base, mid)["end"] <= span["start"]
        live = acc["lo"] < acc["hi"]
        return F.struct(F.when(live & left, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(live & ~left, mid).otherwise(acc["hi"]).alias("hi"))

    steps = F.sequence(F.lit(1), F.length(F.bin(F.size(base))))
    found = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(base).alias("hi")), step)["lo"]
    return F.coalesce(F.get(base, found)["start"] < span["end"], F.lit(False))


def with_spans(rows: DataFrame, text: str, base: str, every: str) -> DataFrame:
    """``rows`` with the columns ``base`` and ``every``: spans of the column ``text`` in order of start and kind."""
    columns, own = rows.columns, fresh_prefix(rows.columns, "__at")
    patterns = [(ASSIGN, 8), (ACCESS, 0), (HEX, 0), (CANDIDATE, 0)]
    m, n, found = ([f"{own}{c}{k}" for k in range(4)] for c in "mns")
    rows = rows.withColumns({m[k]: _matches(F.col(text), p, keep > 0) for k, (p, keep) in enumerate(patterns)})
    rows = rows.withColumns({n[k]: F.transform(m[k], lambda r: F.length(r["gap"]) + F.length(r["hit"])) for k in range(4)})
    rows = with_running(rows, n, "a + b")

    def spans(k: int) -> Column:
        def made(r: Column, before: Column) -> Column:
            start = before + F.length(r["gap"])
            return F.struct(start.alias("start"), F.lit(k).alias("kind"), (start + F.length(r["hit"])).alias("end"), r["hit"].alias("word"), r["second"].alias("second"))

        keep = patterns[k][1]
        both = F.zip_with(m[k], f"{n[k]}_run", made)
        return F.filter(both, lambda r: F.length(r["second"]) >= keep) if keep else both

    rows = rows.withColumns({found[k]: spans(k) for k in range(4)})
    bare = lambda c: F.transform(c, lambda r: F.struct(r["start"].alias("start"), r["kind"].alias("kind"), r["end"].alias("end")))
    apart = lambda s: ~(_touches(s, F.col(found[0])) | _touches(s, F.col(found[1])) | _touches(s, F.col(found[2])))
    more = F.filter(found[3], lambda s: _plausible(s["word"]) & apart(s) & _is_secret(s["word"]))
    three = F.concat(*(bare(c) for c in found[:3]))
    return rows.withColumns({base: F.array_sort(three), every: F.array_sort(F.concat(three, bare(more)))}).select(*columns, base, every)


def _shown(spans: str) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every document."""
    rows = with_spans(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), "text", "base", "every")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return rows.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_shown("base"), 256).alias("base_sha256"),
        _shown("every").alias("spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind; n_chars, where there is one, follows.

    Of spans that overlap the first alone shows its kind. Texts with spans are
    cut from blocks of code points, so a text's length doesn't slow a cut.
    """
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    own = fresh_prefix(docs.columns)
    text, base, every, ends, parts, clean = (f"{own}_{x}" for x in ("text", "base", "every", "ends", "parts", "clean"))
    rows = with_spans(docs.withColumn(text, F.coalesce(F.col("text"), F.lit(""))), text, base, every)
    rows = with_running(rows.withColumn(ends, F.transform(every, lambda s: s["end"])), [ends], "greatest(a, b)")
    rows = rows.withColumn(parts, F.when(F.size(every) > 0, F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{_CUT}}}"), F.lit(0))))

    def cut(start: Column, stop: Column) -> Column:
        low, high = F.floor(start / _CUT).cast("int"), F.floor((stop + _CUT - 1) / _CUT).cast("int")
        return F.substring(F.array_join(F.slice(parts, low + 1, high - low), ""), start % _CUT + 1, stop - start)

    both = F.filter(F.zip_with(every, f"{ends}_run", lambda s, x: F.struct(x.alias("at"), s.alias("span"))), lambda b: b["span"]["start"] >= b["at"])
    shown = F.transform(both, lambda b: F.concat(cut(b["at"], b["span"]["start"]), F.element_at(names, b["span"]["kind"] + 1)))
    rest = cut(F.array_max(ends), F.length(text))
    rows = rows.withColumn(clean, F.when(F.size(every) > 0, F.concat(F.array_join(shown, ""), rest)).otherwise(F.col("text")))
    changed = {"text": F.col(clean)}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(F.size(every) > 0, F.length(clean).cast(kind)).otherwise(F.col("n_chars"))
    return rows.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns))


def oracle() -> str:
    """DuckDB SQL for :func:`scan` over the view ``documents``."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    loose = ASSIGN.replace(r"\x20", " ")

    def spans(pattern: str, kind: int, keep: bool) -> str:
        second = f"regexp_extract_all(t, {q(pattern)}, 2)" if keep else "hits"
        return f"""
        SELECT doc_id, t, unnest(list_transform(range(1, len(hits) + 1), lambda i: {{'start': list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda h: length(h))), 0), 'hit': hits[i], 'second': seconds[i]}}), recursive := true), {kind} AS kind
        FROM (SELECT doc_id, t, hits, {second} AS seconds, regexp_split_to_array(t, {q(pattern)}) AS gaps
              FROM (SELECT doc_id, t, regexp_extract_all(t, {q(pattern)}) AS hits FROM d WHERE regexp_matches(t, {q(pattern)})))"""

    allowed = ALLOWED.replace(r"|(.)\2{7}", "")
    repeats = " OR ".join(f"contains(hit, repeat('{c}', 8))" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")
    cases = " ".join(
        f"WHEN regexp_full_match(hit, '{chars}') THEN list_max(list_transform(range(1, length(hit) - {w} + 2), lambda i: log2({w}) - list_sum(list_transform(list_distinct(string_split(substr(hit, i, {w}), '')), lambda c: ({w} - length(replace(substr(hit, i, {w}), c, ''))) * log2({w} - length(replace(substr(hit, i, {w}), c, ''))))) / {w})) >= {bits} - 1e-9"
        for chars, w, bits in CLASSES.values()
    )
    names = "['" + "', '".join(KINDS) + "'][kind + 1]"
    shown = f"coalesce(string_agg({names} || ':' || s || ':' || e, ',' ORDER BY s, kind), '')"
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    raw AS ({spans(loose, 0, True)} UNION ALL {spans(ACCESS, 1, False)} UNION ALL {spans(HEX, 2, False)}),
    base AS (SELECT doc_id, kind, start::BIGINT AS s, (start + length(hit))::BIGINT AS e FROM raw WHERE kind > 0 OR length(second) >= 8),
    cand AS (SELECT doc_id, kind, hit, start::BIGINT AS s, (start + length(hit))::BIGINT AS e FROM ({spans(CANDIDATE, 3, False)})),
    more AS (SELECT doc_id, kind, s, e FROM cand
             WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = cand.doc_id AND b.s < cand.e AND cand.s < b.e)
               AND regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Za-z]')
               AND NOT regexp_matches(hit, {q(allowed)}) AND NOT ({repeats.replace("repeat(", "repeat(")})
               AND (CASE {cases} ELSE false END)),
    b AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, {shown} AS shown FROM base GROUP BY doc_id),
    a AS (SELECT doc_id, {shown} AS shown FROM (SELECT * FROM base UNION ALL SELECT * FROM more) GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
           sha256(coalesce(b.shown, '')) AS base_sha256, coalesce(a.shown, '') AS spans
    FROM d LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id)"""
