"""A store of blocks as a stream with offsets: new blocks in ranges, each once, in order of their numbers."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Blocks that one scan takes, and so one partition.
SPAN = 25

SCHEMA = "chain string, number bigint, us bigint, gas_used double, gas_limit double, size double, tx bigint"
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def store_blocks(blocks: DataFrame, path: str, span: int = 1000) -> None:
    """Add blocks to a store: files by chain and range of `span` numbers."""
    b = blocks.select("chain", "number", "us", *[F.col(c).cast("double").alias(c) for c in ("gas_used", "gas_limit", "size")], F.col("tx").cast("long").alias("tx"))
    b.filter("number is not null and chain is not null").withColumn("range", F.expr(f"number div {span}")).repartition("chain", "range").write.partitionBy("chain", "range").mode("append").parquet(path)


@dataclass
class Range(InputPartition):
    """Blocks of a chain with numbers from `first` up to before `end`, and the files that may hold them."""

    chain: str
    first: int
    end: int
    files: tuple[str, ...]


class _Folder:
    """The files of a store by chain and range, wherever it lies."""

    def __init__(self, path: str):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def files(self) -> dict[str, dict[int, list[str]]]:
        from urllib.parse import unquote

        from pyarrow import fs

        out: dict[str, dict[int, list[str]]] = {}
        for f in self.fs.get_file_info(fs.FileSelector(self.root, recursive=True, allow_not_found=True)):
            parts = f.path.split("/")
            if f.is_file and f.path.endswith(".parquet") and "_temporary" not in parts:
                chain, at = (p.split("=", 1)[1] for p in parts[-3:-1])
                out.setdefault(unquote(chain), {}).setdefault(int(at), []).append(f.path)
        return out

    def read(self, file: str, columns: list[str]):
        import pyarrow.parquet as pq

        return pq.read_table(file, columns=columns, filesystem=self.fs, partitioning=None)


class BlockReader(DataSourceStreamReader):
    """Offsets are the next number of each chain. What is on offer ends before the first number that is missing, so that a block which comes later is not lost."""

    def __init__(self, options: dict):
        self.folder = _Folder(options["path"])
        self.span, self.behind = int(options.get("span", SPAN)), int(options.get("behind", 0))
        #: How far each chain was whole when last looked at, and the bounds of files, which do not change: only hints, a new reader finds them again.
        self.whole: dict[str, int] = {}
        self.bounds: dict[str, tuple[int, int]] = {}

    def initialOffset(self) -> dict:
        return {"chains": json.dumps({})}

    def latestOffset(self) -> dict:
        for chain, ranges in self.folder.files().items():
            known = self.whole.get(chain)
            # Files are in ranges of one width, so ranges in order are numbers in order.
            for at in sorted(ranges):
                if known is not None and self._bounds(ranges[at])[1] < known:
                    continue
                found = {n for file in ranges[at] for n in self.folder.read(file, ["number"]).column(0).to_pylist()}
                first = known if known is not None else min(found)
                numbers = {n for n in found if n >= first}
                while first in numbers:
                    first += 1
                known = first
                if numbers and max(numbers) >= first:
                    break  # a gap
            if known is not None:
                self.whole[chain] = known
        return {"chains": json.dumps({c: n - self.behind for c, n in sorted(self.whole.items()) if n > self.behind})}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        begin, stop = json.loads(start["chains"]), json.loads(end["chains"])
        files, out = self.folder.files(), []
        for chain, last in stop.items():
            mine = files.get(chain, {})
            numbers = {at: self._bounds(mine[at]) for at in sorted(mine)}
            first = begin.get(chain, min((low for low, _ in numbers.values()), default=last))
            for at in range(first, last, self.span):
                to = min(at + self.span, last)
                out.append(Range(chain, at, to, tuple(f for r, (low, high) in numbers.items() if low < to and high >= at for f in mine[r])))
        return out

    def _bounds(self, files: list[str]) -> tuple[int, int]:
        """The least and the largest number in files, from their footers."""
        import pyarrow.parquet as pq

        for f in files:
            if f not in self.bounds:
                m = pq.read_metadata(f, filesystem=self.folder.fs)
                at = m.schema.names.index("number")
                groups = [m.row_group(k).column(at).statistics for k in range(m.num_row_groups)]
                self.bounds[f] = (min(g.min for g in groups), max(g.max for g in groups))
        return min(self.bounds[f][0] for f in files), max(self.bounds[f][1] for f in files)

    def read(self, partition: Range):
        rows = []
        for file in partition.files:
            t = self.folder.read(file, _COLUMNS[1:])
            rows += [(partition.chain, *r) for r in zip(*(t.column(c).to_pylist() for c in _COLUMNS[1:]), strict=True) if partition.first <= r[0] < partition.end]
        yield from sorted(rows, key=lambda r: r[1:3])


class BlockStore(DataSource):
    """`spark.readStream.format("block_store").load(path)`; options: span, blocks of a partition, and behind, how many of a chain's latest blocks are not yet final."""

    @classmethod
    def name(cls) -> str:
        return "block_store"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> BlockReader:
        return BlockReader(dict(self.options))


def read_store(spark: SparkSession, path: str, **options) -> DataFrame:
    """The stream of a store's blocks."""
    spark.dataSource.register(BlockStore)
    return spark.readStream.format("block_store").options(**options).load(path)
