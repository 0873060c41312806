"""Fill-in-the-middle examples, made by DuckDB inside each task.

A slab of rows is registered as an Arrow table; one SQL statement cuts the texts
into units with regexp_extract_all, draws the two cuts and the form from a sha256
of the seed and the document's id, slices the units, lays the parts out between
sentinels, rebuilds each text from its output, and hands Arrow back.  No row
passes through Python, and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .tables import read
from .textkit import slabs

#: A line with its end, or what is left after the last.
LINES = r"[^\n]*\n|[^\n]+"
#: Marks of prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
SEED, RATE, SPM_RATE = 7, 100, 50
#: What fill_in_middle() can return, in this order.
COLUMNS = {"doc_id": "long", "n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string", "output_sha256": "string", "restored_sha256": "string"}
_SLAB_BYTES = 4 << 20


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _checked(sentinels: tuple[str, str, str]) -> list[str]:
    """The sentinels as SQL; none may hold another, or end as one begins, so that none is found where two parts meet."""
    if len(set(sentinels)) < 3:
        raise ValueError("three different sentinels are needed")
    for a in sentinels:
        for b in sentinels:
            if not a or (a != b and a in b) or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)) + (a != b))):
                raise ValueError(f"sentinels that overlap: {a!r}, {b!r}")
    return [_quoted(s) for s in sentinels]


def restored_sql(output: str, form: str, sentinels: tuple[str, str, str] = SENTINELS) -> str:
    """SQL for the text that an output of some form was made from."""
    p, s, m = _checked(sentinels)

    def parts(first: str, second: str) -> tuple[str, str, str]:
        body = f"substr({output}, {1 + len(first) - 2})"  # without the quotes
        rest = f"split_part({body}, {second}, 2)"
        return f"split_part({body}, {second}, 1)", f"split_part({rest}, {m}, 1)", f"split_part({rest}, {m}, 2)"

    prefix, suffix, middle = parts(p, s)
    after, before, between = parts(s, p)
    return f"CASE {form} WHEN 'psm' THEN {prefix} || {middle} || {suffix} WHEN 'spm' THEN {before} || {between} || {after} ELSE {output} END"


def example_sql(seed: int, rate: int, spm_rate: int, unit: str, sentinels: tuple[str, str, str]) -> str:
    """The statement over a table ``slab`` (doc_id, text)."""
    p, s, m = _checked(sentinels)
    draw = [f"CAST(CAST('0x' || substr(h, {1 + 8 * k}, 8) AS UINTEGER) AS BIGINT) AS h{k + 1}" for k in range(4)]
    marked = " OR ".join(f"contains(text, {q})" for q in (p, s, m))
    join = "coalesce(array_to_string(list_slice(units, {}, {}), ''), '')"
    return f"""
    WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, sha256({_quoted(f'{seed}:')} || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM slab),
    cut AS (SELECT doc_id, text, regexp_extract_all(text, {_quoted(unit)}) AS units, {', '.join(draw)} FROM texts),
    placed AS (SELECT *, CAST(len(units) AS BIGINT) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
        CASE WHEN text = '' OR {marked} OR h3 % 100 >= {rate} THEN 'plain' WHEN h4 % 100 < {spm_rate} THEN 'spm' ELSE 'psm' END AS form FROM cut),
    parts AS (SELECT doc_id, text, n, form, {join.format(1, 'a')} AS prefix, {join.format('a + 1', 'b')} AS middle, {join.format('b + 1', 'n')} AS suffix FROM placed),
    made AS (SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
        CASE form WHEN 'plain' THEN text WHEN 'psm' THEN {p} || prefix || {s} || suffix || {m} || middle ELSE {s} || suffix || {p} || prefix || {m} || middle END AS output FROM parts)
    SELECT *, sha256(output) AS output_sha256, sha256({restored_sql('output', 'form', sentinels)}) AS restored_sha256 FROM made"""


def fill_in_middle(docs: DataFrame, columns: tuple[str, ...] = tuple(COLUMNS), seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, unit: str = LINES, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """One row for each row of ``docs``, with those of COLUMNS that are asked for.

    ``n`` units (matches of ``unit``, which must cover any text) are cut in two
    places drawn from the id, so equal rows get equal outputs, whatever the order or
    partitioning.  The form is plain for an empty text, for one that holds a
    sentinel and for a share of 100 - ``rate`` percent; of the rest ``spm_rate``
    percent are spm.  A null text is empty; a null doc_id draws as an empty string;
    an empty table gives no rows; other columns of ``docs`` don't matter.
    """
    if unknown := set(columns) - set(COLUMNS):
        raise ValueError(f"no such columns: {sorted(unknown)}")
    sql = f"SELECT {', '.join(columns)} FROM ({example_sql(seed, rate, spm_rate, unit, sentinels)})"
    schema = ", ".join(f"{c} {COLUMNS[c]}" for c in columns)
    kinds = pa.schema([(c, pa.int64() if COLUMNS[c] == "long" else pa.string()) for c in columns])

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with duckdb.connect(config={"threads": 1}) as con:
            for batch in batches:
                for slab in slabs(batch.column(1), _SLAB_BYTES):
                    con.register("slab", pa.table({"doc_id": batch.column(0).slice(slab.first, slab.n), "text": batch.column(1).slice(slab.first, slab.n)}))
                    yield from con.sql(sql).to_arrow_table().cast(kinds).to_batches()
                    con.unregister("slab")

    return docs.select("doc_id", "text").mapInArrow(examples, schema)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle(read(spark, sf_dir, "documents"), tuple(c for c in COLUMNS if c != "output"))


QUERIES = {"op12_fill_in_middle": op12_fill_in_middle}
#: Units by splitting at line ends, numbers from single hex digits, parts by places in the text: the operator's statement has none of these.
ORACLE_SQL = {
    "op12_fill_in_middle": f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || doc_id) AS h FROM documents),
    draws AS (SELECT doc_id, t, list_transform(range(4), lambda k: list_reduce(list_transform(range(8), lambda i: CAST(strpos('0123456789abcdef', substr(h, k * 8 + i + 1, 1)) - 1 AS BIGINT)), lambda x, y: x * 16 + y)) AS r FROM d),
    lines AS (SELECT *, string_split(t, chr(10)) AS pieces FROM draws),
    ends AS (SELECT *, len(pieces) - CASE WHEN pieces[-1] = '' THEN 1 ELSE 0 END AS n, list_transform(pieces, lambda x: length(x) + 1) AS sizes FROM lines),
    cuts AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b FROM ends),
    places AS (SELECT doc_id, t, n, r, least(length(t), coalesce(list_sum(sizes[1:a]), 0)) AS p, least(length(t), coalesce(list_sum(sizes[1:b]), 0)) AS q,
        t = '' OR position('<P>' IN t) + position('<S>' IN t) + position('<M>' IN t) > 0 OR r[3] % 100 >= {RATE} AS plain FROM cuts),
    forms AS (SELECT *, CASE WHEN plain THEN 'plain' WHEN r[4] % 100 < {SPM_RATE} THEN 'spm' ELSE 'psm' END AS form FROM places)
    SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN NOT plain THEN CAST(p AS BIGINT) END AS prefix_chars, CASE WHEN NOT plain THEN CAST(q - p AS BIGINT) END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || left(t, CAST(p AS BIGINT)) || '<S>' || substr(t, CAST(q AS BIGINT) + 1) || '<M>' || substr(t, CAST(p AS BIGINT) + 1, CAST(q - p AS BIGINT))
            ELSE '<S>' || substr(t, CAST(q AS BIGINT) + 1) || '<P>' || left(t, CAST(p AS BIGINT)) || '<M>' || substr(t, CAST(p AS BIGINT) + 1, CAST(q - p AS BIGINT)) END) AS output_sha256, sha256(t) AS restored_sha256 FROM forms"""
}
