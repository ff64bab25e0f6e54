"""The engine as an object, and the command line: images to text, hOCR or JSON."""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelight.operators import recognize, render
from pagelight.sources import images, model
from pagelight.sources.documents import Documents

VERSION = "0.3.0"
#: Endings of document files.
ENDINGS = {"text": "txt", "hocr": "hocr", "json": "json"}


class NoImageLoaded(RuntimeError):
    """There is nothing to recognize yet."""


class Engine:
    """A model, and the images set last."""

    def __init__(self, spark: SparkSession, data: bytes) -> None:
        self.spark, self.model, self.rasters, self.names = spark, model.load(data), None, None

    def set_files(self, path: str) -> Engine:
        self.rasters, self.names = images.from_files(self.spark, path), images.names(self.spark, path)
        return self

    def set_memory(self, data: DataFrame) -> Engine:
        self.rasters, self.names = images.from_memory(data), None
        return self

    def set_raw(self, pages: DataFrame) -> Engine:
        self.rasters, self.names = images.from_raw(pages), None
        return self

    def recognize(self) -> DataFrame:
        if self.rasters is None:
            raise NoImageLoaded("set images first")
        rasters = self.rasters
        if "_error" in rasters.columns:
            rasters = rasters.where("_error is null")
        return recognize.recognize(rasters.select("page_id", "width", "height", "channels", "data"), self.model)

    def documents(self, form: str = "text") -> DataFrame:
        """(page_id, document)."""
        return render.rendered(self.recognize(), form)

    def save(self, folder: str, form: str = "text", mode: str = "append") -> None:
        """A file for each page in the folder: by the name of its image's file where it has one, else by its id."""
        found = self.documents(form)
        if self.names is not None:
            names = self.names.select("page_id", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"))
            found = found.join(names, "page_id").select("name", "document")
        else:
            found = found.select(F.col("page_id").cast("string").alias("name"), "document")
        self.spark.dataSource.register(Documents)
        found.write.format("pagelight_documents").mode(mode).option("ending", ENDINGS[form]).save(folder)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="pagelight", description="Recognize text in images.")
    p.add_argument("image", help="an image file, a folder or a pattern")
    p.add_argument("-m", "--model", help="a model file")
    p.add_argument("--format", choices=("text", "hocr", "json"), default="text")
    p.add_argument("-o", "--output", help="a folder for the documents, one file for each page; without it they are printed")
    p.add_argument("--version", action="version", version=VERSION)
    a = p.parse_args(argv)
    try:
        data = model.read(model.find(a.model))
        spark = SparkSession.builder.appName("pagelight").getOrCreate()
        engine = Engine(spark, data).set_files(a.image)
        unread = engine.rasters.where("_error is not null").select("path", "_error")
        for row in unread.toLocalIterator():
            print(f"{row['path']}: {row['_error']}", file=sys.stderr)
        if a.output:
            engine.save(a.output, a.format)
        else:
            for row in engine.documents(a.format).orderBy("page_id").toLocalIterator():
                print(row["document"], end="\n" if a.format == "text" else "")
    except (OSError, ValueError, AnalysisException) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
