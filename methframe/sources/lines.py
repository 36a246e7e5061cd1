"""Text records that may be damaged: typed rows apart from failed lines with their reason."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as csv
from pyspark.sql import DataFrame

from methframe.session import ship

#: Fixed values of the line format: seven fields between tabs.
FIELDS = ["chrom", "pos", "strand", "context", "mc", "cov", "flag"]
MAX_POS = "9223372036854775807"
MAX_COUNT = "65535"

#: A field that begins with a quote ends at the matching one; no other field holds a quote.
_FIELD = r'(?:"(?:[^"]|"")*"|[^"\t]*)'
_QUOTING = rf'\A(?s:{_FIELD}(?:\t{_FIELD})*)\z'
#: A slice of lines for the CSV reader; a longer line is a slice of its own.
_SLICE_BYTES = 32 << 20


def _trim_end(lines: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(lines, r"\r\z", "")


def _protect(lines: pa.Array) -> pa.Array:
    """Line ends within a line, which the CSV reader would take for the end of a record, in a form that can be undone."""
    for a, b in (("\x10", "\x10a"), ("\r", "\x10b"), ("\n", "\x10c")):
        lines = pc.replace_substring(lines, a, b)
    return lines


def _restore(values: pa.Array) -> pa.Array:
    for a, b in (("\x10c", "\n"), ("\x10b", "\r"), ("\x10a", "\x10")):
        values = pc.replace_substring(values, a, b)
    return values


def _read(numbers: list[int], lines: list[str]) -> tuple[pa.Table, dict[int, int]]:
    """The rows with all fields, as strings, and of the rejected ones the number of fields found."""
    rejected: dict[int, int] = {}

    def reject(row) -> str:
        rejected[int(row.text.partition("\t")[0])] = row.actual_columns - 1
        return "skip"

    data = "".join(f"{n}\t{line}\n" for n, line in zip(numbers, lines)).encode()
    names = ["_n", *FIELDS]
    rows = csv.read_csv(
        pa.BufferReader(data),
        csv.ReadOptions(column_names=names, block_size=min(max(len(data) + 16, 1024), (1 << 31) - 1), use_threads=False),
        csv.ParseOptions(delimiter="\t", quote_char='"', double_quote=True, newlines_in_values=False, ignore_empty_lines=False, invalid_row_handler=reject),
        csv.ConvertOptions(column_types={"_n": pa.int64(), **{f: pa.string() for f in FIELDS}}, strings_can_be_null=False, null_values=[]),
    )
    return rows, rejected


def _number(values: pa.Array, least: int, most: str) -> tuple[pa.Array, pa.Array]:
    """Digits within bounds as numbers, with the mask of the cells that hold one."""
    digits = pc.match_substring_regex(values, r"\A[0-9]+\z")
    bare = pc.ascii_ltrim(values, "0")
    length = pc.utf8_length(bare)
    fits = pc.or_(pc.less(length, len(most)), pc.and_(pc.equal(length, len(most)), pc.less_equal(bare, most)))
    good = pc.and_(digits, pc.fill_null(fits, False))
    numbers = pc.cast(pc.if_else(good, pc.if_else(pc.equal(length, 0), "0", bare), pa.scalar(None, pa.string())), pa.int64())
    good = pc.and_(good, pc.fill_null(pc.greater_equal(numbers, least), False))
    return numbers, good


def _label(rows: pa.Table) -> dict[str, pa.Array]:
    """Casts of whole columns; the first failing cell gives the reason."""
    columns = {f: _restore(rows.column(f).combine_chunks()) for f in FIELDS}
    pos, pos_ok = _number(columns["pos"], 1, MAX_POS)
    mc, mc_ok = _number(columns["mc"], 0, MAX_COUNT)
    cov, cov_ok = _number(columns["cov"], 0, MAX_COUNT)
    over = pc.fill_null(pc.greater(mc, cov), False)
    reason = pa.nulls(len(rows), pa.string())
    for name, bad in (("mc_over_cov", over), ("cov", pc.invert(cov_ok)), ("mc", pc.invert(mc_ok)), ("pos", pc.invert(pos_ok))):
        reason = pc.if_else(bad, name, reason)
    return columns | {"pos": pos, "mc": mc.cast(pa.int32(), safe=False), "cov": cov.cast(pa.int32(), safe=False), "reason": reason}


def parse_lines(df: DataFrame, line_id: str, text: str) -> DataFrame:
    """One row per record: line_id, reason (null: valid), the typed fields of a valid record, and raw of a failed one.

    Reasons, the first that applies: ``quoting``, ``columns``, ``pos``, ``mc``, ``cov``, ``mc_over_cov``. One carriage
    return at the end isn't part of a line. Null lines, lines that are then empty and comments (``#``) are neither records
    nor failures. Carriage returns and line feeds elsewhere are part of a field. Lines are read whole, whatever their
    length. Repeated lines each come out. An empty table gives no rows.
    """
    ship(df.sparkSession)
    kind = df.schema[line_id].dataType.simpleString()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lines = batch.column(0), _trim_end(batch.column(1))
            record = pc.and_(pc.greater(pc.binary_length(lines), 0), pc.invert(pc.starts_with(lines, "#")))
            record = pc.fill_null(record, False)
            ids, lines = ids.filter(record), lines.filter(record)
            if not len(lines):
                continue
            quoted = pc.match_substring_regex(lines, _QUOTING)
            schema = pa.schema([("id", ids.type), ("reason", pa.string()), ("chrom", pa.string()), ("pos", pa.int64()), ("strand", pa.string()), ("context", pa.string()), ("mc", pa.int32()), ("cov", pa.int32()), ("flag", pa.string()), ("raw", pa.string())])

            def failed(at: pa.Array, reason: str) -> pa.RecordBatch:
                k = len(at)
                return pa.RecordBatch.from_arrays([ids.take(at), pa.array([reason] * k, pa.string()), *[pa.nulls(k, schema.field(f).type) for f in FIELDS], lines.take(at)], schema=schema)

            broken = pc.indices_nonzero(pc.invert(quoted))
            if len(broken):
                yield failed(broken, "quoting")
            good = pc.indices_nonzero(quoted).to_pylist()
            safe = _protect(lines).take(pa.array(good, pa.int64())).to_pylist()
            at = 0
            while at < len(good):
                end, size = at, 0
                while end < len(good) and (end == at or size + len(safe[end]) * 4 < _SLICE_BYTES):
                    size += len(safe[end]) * 4
                    end += 1
                rows, rejected = _read(good[at:end], safe[at:end])
                if rejected:
                    yield failed(pa.array(sorted(rejected), pa.int64()), "columns")
                if len(rows):
                    found, where = _label(rows), rows.column("_n").combine_chunks()
                    bad = pc.is_valid(found["reason"])
                    hide = lambda v: pc.if_else(bad, pa.scalar(None, v.type), v)
                    yield pa.RecordBatch.from_arrays([ids.take(where), found["reason"], *[hide(found[f]) for f in FIELDS], pc.if_else(bad, lines.take(where), pa.scalar(None, pa.string()))], schema=schema)
                at = end

    out = df.select(df[line_id].alias("id"), df[text].alias("line")).mapInArrow(parse, f"id {kind}, reason string, chrom string, pos bigint, strand string, context string, mc int, cov int, flag string, raw string")
    return out.withColumnRenamed("id", line_id)


def split_lines(parsed: DataFrame, line_id: str) -> tuple[DataFrame, DataFrame]:
    """The valid rows, typed, and the failed lines with their reason."""
    return parsed.where("reason is null").select(line_id, *FIELDS), parsed.where("reason is not null").select(line_id, "reason", "raw")
