"""Model files as tables, through Spark's reader:

    spark.dataSource.register(ModelTables)
    spark.read.format("pagelight_model").option("table", "characters").load("models/*.traineddata")

Tables: components, characters, codes, edges, layers; each with the file's path. Only the head of a file is read to plan a scan; every
component is a partition of its own, read from its place in the file, so many models are read at once. Files are opened where the tasks
run: the folder must be one that all of them see.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pagelight.sources import model

_SCHEMAS = {
    "components": "path string, idx int, offset long, size long, payload binary",
    "characters": "path string, id int, unichar string, properties int, script string, other_case long, direction int, mirror long, normed string",
    "codes": "path string, id int, self_normalized boolean, codes array<int>",
    "edges": "path string, graph string, start_bit int, edge long, rec long",
    "layers": "path string, layer string, kind string, inputs int, outputs int",
}
GRAPHS = {model.PUNC: "punctuation", model.SYSTEM: "system", model.NUMBER: "number"}


class Component(InputPartition):
    def __init__(self, path: str, idx: int, offset: int, size: int) -> None:
        super().__init__((path, idx))
        self.path, self.idx, self.offset, self.size = path, idx, offset, size


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str) -> None:
        self.path, self.table = path, table

    def partitions(self) -> list[Component]:
        pattern = os.path.join(self.path, "*") if os.path.isdir(self.path) else self.path
        files = sorted(f for f in glob.glob(pattern) if os.path.isfile(f))
        if not files:
            raise FileNotFoundError(f"ModelNotFound: {self.path}")
        out = []
        for f in files:
            with open(f, "rb") as opened:
                there = model.places(opened.read(model.HEAD), os.path.getsize(f))
            wanted = {"characters": {model.CHARSET}, "layers": {model.LSTM}, "edges": set(GRAPHS)}.get(self.table)
            if self.table == "codes":  # in the network's component where there is none of their own
                wanted = {model.RECODER} if any(i == model.RECODER for i, _, _ in there) else {model.LSTM}
            out += [Component(f, *x) for x in there if wanted is None or x[0] in wanted]
        return out

    def read(self, partition: Component) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            f.seek(partition.offset)
            data = f.read(partition.size)
        path = partition.path
        if self.table == "components":
            yield path, partition.idx, partition.offset, partition.size, data
        elif self.table == "characters":
            yield from ((path, *row) for row in model.charset(data))
        elif self.table == "codes":
            yield from ((path, *row) for row in (model.recoder(model.Reader(data)) if partition.idx == model.RECODER else model.own_codes(data)))
        elif self.table == "layers":
            yield from ((path, *row) for row in model.layer_rows(model.network(model.Reader(data))))
        else:
            bits, edges = model.word_graph(data)
            yield from ((path, GRAPHS[partition.idx], bits, i, rec) for i, rec in enumerate(edges.tolist()))


class ModelTables(DataSource):
    """The source. Options: path, table ("components" where it is not given)."""

    @classmethod
    def name(cls) -> str:
        return "pagelight_model"

    def _table(self) -> str:
        table = self.options.get("table", "components")
        if table not in _SCHEMAS:
            raise ValueError(f"no table {table}; there are {', '.join(_SCHEMAS)}")
        return table

    def schema(self) -> str:
        return _SCHEMAS[self._table()]

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"].removeprefix("file://"), self._table())
