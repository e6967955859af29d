"""CSV records of any size over many tasks, bound by the header of their own file.

Spark cuts a large text file into blocks of lines. Whether a block begins inside a
quoted field is not known to its task, so a first pass learns what every block does to
that state (two bits: where it ends if it begins outside, and if it begins inside).
The states are chained over the blocks of a file, and a second pass joins lines
to records, starting each block in its right state. A record that crosses blocks is put
together from its fragments afterwards. Files may differ in the order of their columns.
"""

from __future__ import annotations

import csv
import io
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

RECORDS = "file string, signature int, fields array<string>, whole boolean, raw string"
PARTS = ("file string, block long, place long, kind string, text string")


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """Every line with its file and block; a line is of the block it begins in."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), "value")


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a quoted field is open after the line.

    A quote opens a field only as its first character, a doubled one inside is a quote,
    and after the closing quote anything up to the comma belongs to the field.
    """
    at = 0
    while True:
        if not inside:
            if line[at:at + 1] == '"':
                inside, at = True, at + 1
            else:
                comma = line.find(",", at)
                if comma < 0:
                    return False
                at = comma + 1
                continue
        quote = line.find('"', at)
        if quote < 0:
            return True
        if line[quote + 1:quote + 2] == '"':
            at = quote + 2
            continue
        comma = line.find(",", quote + 1)
        if comma < 0:
            return False
        inside, at = False, comma + 1


def blocks_of(batches: Iterator[pa.RecordBatch], start) -> Iterator[tuple[tuple, list[str]]]:
    """The lines of every batch by block; ``start`` is told of a new block."""
    current = None
    for batch in batches:
        files, blocks, values = (c.to_pylist() for c in batch.columns)
        lo = 0
        for hi in range(1, len(values) + 1):
            if hi == len(values) or (files[hi], blocks[hi]) != (files[lo], blocks[lo]):
                if (files[lo], blocks[lo]) != current:
                    current = files[lo], blocks[lo]
                    start(current)
                yield current, values[lo:hi]
                lo = hi


def _learn_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a block: its end state from either start state, and a file's header."""
    found: list[dict] = []

    def start(key):
        found.append({"file": key[0], "block": key[1], "outside": False, "inside": True,
                      "header": "" if key[1] == 0 else None, "open": key[1] == 0})

    for _, lines in blocks_of(batches, start):
        own = found[-1]
        for line in lines:
            if own["open"]:
                own["header"] += ("\n" if own["header"] else "") + line
            if '"' in line:
                own["outside"] = ends_inside(line, own["outside"])
                own["inside"] = ends_inside(line, own["inside"])
            if own["open"] and not own["outside"]:
                own["open"] = False
        if len(found) > 1:
            yield _states(found[:-1])
            found = found[-1:]
    yield _states(found)


def _states(found: list[dict]) -> pa.RecordBatch:
    kinds = {"file": pa.string(), "block": pa.int64(), "outside": pa.bool_(), "inside": pa.bool_(),
             "header": pa.string()}
    return pa.record_batch([pa.array([f[k] for f in found], t) for k, t in kinds.items()],
                           names=list(kinds))


def key_of(file: str, block: int) -> int:
    import hashlib
    return int.from_bytes(hashlib.blake2b(f"{block}:{file}".encode(), digest_size=8).digest())


class Plan:
    """What the second pass must know: 9 bytes a block, 10 bytes a file.

    Spark itself lists the files, at a larger size each, on the driver.
    """

    def __init__(self, rows: list, headers: list[list[str]]):
        self.headers = headers
        order = sorted((key_of(r["file"], r["block"]), r["starts"]) for r in rows)
        self.blocks = np.array([k for k, _ in order], np.uint64)
        self.starts = np.array([s for _, s in order], bool)
        files = sorted((key_of(r["file"], -1), r["signature"]) for r in rows if r["block"] == 0)
        self.files = np.array([k for k, _ in files], np.uint64)
        self.signatures = np.array([s for _, s in files], np.int32)

    @staticmethod
    def _at(keys: np.ndarray, key: int) -> int:
        i = int(np.searchsorted(keys, np.uint64(key)))
        if i == len(keys) or int(keys[i]) != key:
            raise RuntimeError("the files or their splits changed between two passes; "
                               "set spark.sql.files.minPartitionNum and run again")
        return i

    def begins_inside(self, file: str, block: int) -> bool:
        return bool(self.starts[self._at(self.blocks, key_of(file, block))])

    def signature(self, file: str) -> int:
        return int(self.signatures[self._at(self.files, key_of(file, -1))])


def learn_plan(lines: DataFrame) -> Plan:
    """Chain the blocks' states along each file; headers are compared by their names."""
    states = lines.mapInArrow(_learn_states, "file string, block long, outside boolean, "
                                             "inside boolean, header string")
    rows = sorted(states.collect(), key=lambda r: (r["file"], r["block"]))     # one a block
    signatures: dict[tuple, int] = {}
    plan, inside = [], False
    for r in rows:
        inside = inside and r["block"] > 0
        own = -1
        if r["block"] == 0:
            names = tuple(n.strip() for n in parse(r["header"].removeprefix("\ufeff")) or [])
            own = signatures.setdefault(names, len(signatures))
        plan.append({"file": r["file"], "block": r["block"], "starts": inside, "signature": own})
        inside = r["inside"] if inside else r["outside"]
    return Plan(plan, [list(s) for s in signatures])


def parse(record: str) -> list[str] | None:
    """The fields of one record; None if it is not one."""
    csv.field_size_limit(sys.maxsize)
    try:
        rows = list(csv.reader(io.StringIO(record, newline=""), strict=False))
    except csv.Error:
        return None
    return rows[0] if len(rows) == 1 else None


def read_records(spark: SparkSession, path: str) -> tuple[DataFrame, list[list[str]]]:
    """All records of CSV files as ``RECORDS``, and the headers by ``signature``.

    ``fields`` are in the order of the file's own header; ``whole`` says whether there
    are as many as header names; ``raw`` is the record's text. Header records and empty
    lines are left out, a byte order mark and the carriage return before a line's end
    too. A field that is never closed takes the rest of its file as one record.
    The records are staged once. An empty file gives nothing.
    """
    from merchlight.session import stage
    lines = lines_of(spark, path)
    plan = learn_plan(lines)
    found = stage(lines.mapInArrow(_joined(plan), f"{PARTS}, {RECORDS[len('file string, '):]}"),
                  "csv-records")
    whole = found.where("kind = 'record'").select("file", "signature", "fields", "whole", "raw")
    # a record over several blocks is opened once; its fragments follow in order
    fragments = found.where("kind <> 'record'").select("file", "block", "place", "kind", "text")
    along = Window.partitionBy("file").orderBy("block", "place")
    joined = fragments.withColumn("n", F.sum(F.when(F.col("kind") == "opens", 1).otherwise(0))
                                  .over(along)) \
        .groupBy("file", "n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
            F.struct("block", "place", "text"))), lambda x: x["text"]), "\n").alias("text"))
    stitched = joined.select("file", "text").mapInArrow(_stitched(plan), RECORDS)
    return whole.unionByName(stitched), plan.headers


def _joined(plan: Plan):
    """Records that lie in one block, and the fragments of others."""
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = {}

        def start(key):
            flush = rest()
            state.update(key=key, inside=plan.begins_inside(*key), held=[], place=0, out=flush,
                         first=plan.begins_inside(*key), header=key[1] == 0,
                         signature=plan.signature(key[0]))

        def rest() -> list[tuple]:
            """What the block before left open."""
            if not state.get("held"):
                return []
            kind = "goes on" if state["first"] else "opens"
            return [(*state["key"], state["place"], kind, "\n".join(state["held"]), *NOTHING)]

        for (file, block), lines in blocks_of(batches, start):
            rows, state["out"] = state["out"], []
            for line in lines:
                if not state["held"] and not state["inside"] and not line.strip():
                    continue
                state["held"].append(line)
                if '"' in line or state["inside"]:
                    state["inside"] = ends_inside(line, state["inside"])
                if state["inside"]:
                    continue
                text, state["held"] = "\n".join(state["held"]), []
                state["place"] += 1
                if state["first"]:              # the end of a record that an earlier block opened
                    state["first"] = False
                    rows.append((file, block, state["place"], "goes on", text, *NOTHING))
                elif state["header"]:
                    state["header"] = False
                else:
                    rows.append((file, block, state["place"], "record", None,
                                 *_record(plan, state["signature"], text)))
            yield _rows(rows)
        yield _rows(rest())

    return joined


NOTHING = (None, None, None, None)


def _record(plan: Plan, signature: int, text: str) -> tuple:
    text = text.removesuffix("\r")
    fields = parse(text)
    return signature, fields, fields is not None and len(fields) == len(plan.headers[signature]), text


ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(),
         "array<string>": pa.list_(pa.string())}


def _rows(rows: list[tuple], schema: str = f"{PARTS}, {RECORDS[len('file string, '):]}"):
    kinds = [c.split() for c in schema.split(", ")]
    columns = list(zip(*rows)) or [[]] * len(kinds)
    return pa.record_batch([pa.array(c, ARROW[k]) for c, (_, k) in zip(columns, kinds)],
                           names=[n for n, _ in kinds])


def _stitched(plan: Plan):
    def stitched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _rows([(file, *_record(plan, plan.signature(file), text)) for file, text in
                         zip(*(c.to_pylist() for c in batch.columns))], RECORDS)

    return stitched


def named(headers: list[list[str]], name: str) -> Column:
    """The column of a name: each file's by its own header, null where it is missing or empty."""
    value = F.lit(None).cast("string")
    for signature, names in enumerate(headers):
        if name in names:
            value = F.when(F.col("signature") == signature,
                           F.get(F.col("fields"), names.index(name))).otherwise(value)
    return F.when(value != "", value)
