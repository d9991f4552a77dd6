"""Dataset import: CSV and JSONL with header aliases."""

from __future__ import annotations

import csv
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.skew import running_sum
from ..session import cut_lineage

# fixed values: accepted column names
ALIASES = {
    "input": ["input"],
    "ground_truth": ["ground_truth", "groundtruth", "expected_output", "expectedoutput"],
    "output": ["output", "model_output", "prediction", "generated_output"],
}


def _aliased(df: DataFrame, target: str) -> Column:
    by_name = {c.strip().lower(): c for c in df.columns}
    found = [F.nullif(F.trim(F.col(f"`{by_name[a]}`")), F.lit("")) for a in ALIASES[target] if a in by_name]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def items_from_rows(df: DataFrame) -> DataFrame:
    """Rows with any accepted header → (input, ground_truth, output); a missing input column is an error."""
    if "input" not in {c.strip().lower() for c in df.columns}:
        raise ValueError("column input is required")
    return df.select(*[_aliased(df, c).alias(c) for c in ALIASES])


def _line_joiner() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of its own, that needs no module of this package where it runs."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lines (file, at, pos, value, n, blank, before) of splits in order → (file, at, pos, record, opens, shuts): lines that
        belong to one record as one. ``opens`` and ``shuts`` say whether the record begins and ends in the split."""
        names = ["file", "at", "pos", "record", "opens", "shuts"]
        key, odd, last, held = None, 0, -1, None  # held: the record that is open, as (pos, texts, opens)

        def rest() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(dict(zip(names, ([key[0]], [key[1]], [held[0]], ["\n".join(held[1])], [held[2]], [False]), strict=True)))

        for batch in batches:
            if not batch.num_rows:
                continue
            files = batch.column(0).dictionary_encode()
            file, at, pos = files.indices.to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            if pos[0] <= last or (np.diff(pos) <= 0).any():
                raise ValueError("lines are not in the order of their file")
            last = pos[-1]
            edges = np.flatnonzero((np.diff(file) != 0) | (np.diff(at) != 0)) + 1
            for a, b in itertools.pairwise([0, *edges.tolist(), len(pos)]):
                now = (files.dictionary[int(file[a])].as_py(), int(at[a]))
                if now != key:
                    if held:
                        yield rest()
                    key, held, odd = now, None, batch.column(6)[a].as_py() % 2
                after = (odd + np.cumsum(batch.column(4).slice(a, b - a).to_numpy())) % 2
                opens, shuts = np.concatenate([[odd], after[:-1]]) == 0, after == 0
                odd = int(after[-1])
                keep = ~(opens & shuts & batch.column(5).slice(a, b - a).to_numpy(zero_copy_only=False))
                if not keep.any():
                    continue
                opens, shuts, own = opens[keep], shuts[keep], pos[a:b][keep]
                first = np.unique(np.concatenate([[0], np.flatnonzero(opens)]))
                ends = np.concatenate([first[1:], [len(own)]])
                lines = pa.ListArray.from_arrays(pa.array(np.append(first, len(own)), pa.int32()), batch.column(3).slice(a, b - a).filter(pa.array(keep)))
                records, opens, shuts, own = pc.binary_join(lines, "\n"), opens[first], shuts[ends - 1], own[first]
                low, high = 0, len(own)
                if held:  # what is open goes on in the first of them
                    held[1].append(records[0].as_py())
                    low = 1
                    if shuts[0]:
                        done = rest()
                        yield done.set_column(5, "shuts", pa.array([True]))
                        held = None
                if high > low and not shuts[-1]:
                    high -= 1
                    held = (int(own[high]), [records[high].as_py()], bool(opens[high]))
                if high > low:
                    n = high - low
                    yield pa.RecordBatch.from_arrays(
                        [pa.repeat(key[0], n), pa.repeat(pa.scalar(key[1], pa.int64()), n), pa.array(own[low:high]), records.slice(low, n), pa.array(opens[low:high]), pa.array(shuts[low:high])], names
                    )
        if held:
            yield rest()

    return joined


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, pos, record) of CSV files, in order of their places; a record may span lines, and a file is many tasks.

    Files are read as lines in splits. A line begins inside a quoted field if the quotes before it in its file are odd in number:
    counts are summed per split, the splits' sums are scanned per file, and every split joins its own lines to records while it
    is read. Only records that cross the edge of a split are shuffled, to be joined to one. Quotes are doubled inside quoted
    fields and don't occur in others; blank lines between records go.
    """
    own = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("pos"))
    lines = own.withColumn("n", F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))))
    splits = lines.groupBy("file", "at").agg(F.sum("n").alias("all"))
    ahead = W.partitionBy("file").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    splits = splits.select("file", "at", F.coalesce(F.sum("all").over(ahead), F.lit(0)).alias("before"))  # a row per split
    placed = lines.join(F.broadcast(splits), ["file", "at"]).select("file", "at", "pos", "value", "n", (F.trim("value") == "").alias("blank"), "before")
    parts = cut_lineage(placed.mapInArrow(_line_joiner(), "file string, at long, pos long, record string, opens boolean, shuts boolean"))
    whole = F.col("opens") & F.col("shuts")
    broken = parts.where(~whole).select("file", "at", "pos", F.col("record").alias("value"), F.col("opens").cast("long").alias("opens"))
    broken = running_sum(broken, ["file"], ["at", "pos"], {"nth": F.col("opens")})
    joined = broken.groupBy("file", "nth").agg(F.array_sort(F.collect_list(F.struct("at", "pos", "value"))).alias("l"))
    joined = joined.select("file", F.col("l")[0]["at"].alias("at"), F.col("l")[0]["pos"].alias("pos"), F.array_join(F.transform("l", lambda x: x["value"]), "\n").alias("record"))
    return parts.where(whole).select("file", "at", "pos", "record").unionByName(cut_lineage(joined))


def read_csv_items(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Every file begins with the same header. Quotes are doubled inside quoted fields. With ``multi_line``, fields may span
    lines; a large file is split either way. Items come in the order of the files."""
    if not multi_line:
        return items_from_rows(spark.read.csv(path, header=True, quote='"', escape='"', mode="FAILFAST"))
    records = csv_records(spark, path)
    place = F.struct("at", "pos")
    heads = cut_lineage(records.groupBy("file").agg(F.min(place).alias("first")))  # a row per file
    top = heads.orderBy("file").first()
    if top is None:
        raise ValueError("column input is required")
    at, pos = top["first"]
    head = records.where((F.col("file") == top["file"]) & (F.col("at") == at) & (F.col("pos") == pos)).select("record").first()
    names = next(csv.reader([head[0]]))
    fields = F.from_csv("record", ", ".join(f"c{i} string" for i in range(len(names))), {"quote": '"', "escape": '"', "mode": "FAILFAST"})
    body = records.join(F.broadcast(heads), "file").where(place != F.col("first")).orderBy("file", "at", "pos").select(fields.alias("f"))
    return items_from_rows(body.select(*[F.col(f"f.c{i}").alias(name) for i, name in enumerate(names)]))


JSONL_SCHEMA = T.StructType([T.StructField(a, T.StringType()) for names in ALIASES.values() for a in names])


def items_from_json(lines: DataFrame, value: str = "value") -> DataFrame:
    """JSON texts → items. ``input`` must be a string; other values are stringified; "" gives null;
    one bad line fails the load."""
    text = F.col(value)
    m = F.from_json(text, "map<string,string>", {"mode": "FAILFAST"})
    pick = lambda target: F.nullif(F.coalesce(*[F.try_element_at(F.col("_m"), F.lit(a)) for a in ALIASES[target]]), F.lit(""))
    kind = F.schema_of_variant(F.variant_get(F.parse_json(text), "$.input", "variant"))
    checked = F.when(F.coalesce(kind == "STRING", F.lit(False)), pick("input")).otherwise(F.raise_error(F.lit("input must be a string")))
    return lines.withColumn("_m", m).select(checked.alias("input"), pick("ground_truth").alias("ground_truth"), pick("output").alias("output"))


def read_jsonl_items(spark: SparkSession, path: str) -> DataFrame:
    return items_from_json(spark.read.text(path))
