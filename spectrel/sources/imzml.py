"""Sources: imzML spectra (Python data source), images, synthetic samples; and sinks.

The driver reads the XML once; each partition seeks to its own spectra in the binary file, which executors must reach by
the same path (a mount; the file is opened by Python, not by Spark's file access). Conditions on pixel_id, x, y and z reach the source, so
that other spectra are not read, and so does a range of masses: where a spectrum's masses ascend, only the intensities of those inside
are read. Partitions have about the same number of bytes.
"""

from __future__ import annotations

import os
import xml.etree.ElementTree as ET

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from spectrel.operators import graph

SCHEMA = "pixel_id bigint, x int, y int, z int, mzs array<double>, intensities array<double>"
#: Accessions of the public controlled vocabulary (fixed values).
POSITION_X, POSITION_Y, POSITION_Z = "IMS:1000050", "IMS:1000051", "IMS:1000052"
OFFSET, LENGTH = "IMS:1000102", "IMS:1000103"
MZ_ARRAY, INTENSITY_ARRAY = "MS:1000514", "MS:1000515"
KINDS = {"MS:1000521": "<f4", "MS:1000523": "<f8", "MS:1000519": "<i4", "MS:1000522": "<i8"}


def read_index(path: str) -> list[tuple]:
    """(x, y, z, (offset, length, kind) of m/z, of intensity) of each spectrum."""
    groups: dict[str, dict] = {}
    out = []
    name = lambda e: e.tag.rpartition("}")[2]
    terms = lambda e: {c.get("accession"): c.get("value") for c in e.iter() if name(c) == "cvParam"}
    for _, e in ET.iterparse(path, events=("end",)):
        if name(e) == "referenceableParamGroup":
            groups[e.get("id")] = terms(e)
        elif name(e) == "spectrum":
            at = terms(e)
            arrays = {}
            for b in (c for c in e.iter() if name(c) == "binaryDataArray"):
                t = terms(b)
                for r in b:
                    if name(r) == "referenceableParamGroupRef":
                        t = groups.get(r.get("ref"), {}) | t
                kind = next((v for k, v in KINDS.items() if k in t), "<f4")
                arrays["m" if MZ_ARRAY in t else "i"] = (int(t[OFFSET]), int(t[LENGTH]), kind)
            out.append((int(at[POSITION_X]), int(at[POSITION_Y]), int(at.get(POSITION_Z) or 1), arrays["m"], arrays["i"]))
            e.clear()
    return out


class _Range(InputPartition):
    def __init__(self, spectra: list[tuple]):
        self.spectra = spectra


#: Whether a value meets a condition that Spark hands over.
CONDITIONS = {EqualTo: lambda v, f: v == f.value, In: lambda v, f: v in f.value, GreaterThan: lambda v, f: v > f.value, GreaterThanOrEqual: lambda v, f: v >= f.value, LessThan: lambda v, f: v < f.value, LessThanOrEqual: lambda v, f: v <= f.value}
PLACES = ("pixel_id", "x", "y", "z")


def opened(path: str):
    return open(path, "rb")


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.parts, self.held = options["path"], int(options.get("partitions", 8)), []
        self.masses = (float(options["mz_min"]), float(options["mz_max"])) if "mz_min" in options else None

    def pushFilters(self, filters):
        for f in filters:
            if type(f) in CONDITIONS and len(f.attribute) == 1 and f.attribute[0] in PLACES and None not in (f.value if isinstance(f, In) else (f.value,)):
                self.held.append((type(f), PLACES.index(f.attribute[0]), f))
            else:
                yield f

    def partitions(self):
        index = [(i, *s) for i, s in enumerate(read_index(self.path))]
        index = [s for s in index if all(CONDITIONS[kind](s[k], f) for kind, k, f in self.held)]
        size = lambda s: sum(n * np.dtype(kind).itemsize for _, n, kind in s[4:])
        total, out, held = sum(map(size, index)), [[]], 0
        for s in index:
            if held * self.parts >= total * len(out) and out[-1]:
                out.append([])
            out[-1].append(s)
            held += size(s)
        return [_Range(x) for x in out]

    def read(self, part):
        if not part.spectra:
            return
        with opened(os.path.splitext(self.path)[0] + ".ibd") as f:

            def values(at: tuple[int, int, str], first: int = 0, last: int | None = None) -> np.ndarray:
                offset, length, kind = at
                n, size = (length if last is None else last) - first, np.dtype(kind).itemsize
                f.seek(offset + first * size)
                return np.frombuffer(f.read(n * size), kind).astype(float)

            for i, x, y, z, masses, intensities in part.spectra:
                m = values(masses)
                if self.masses is None:
                    yield (i, x, y, z, m.tolist(), values(intensities).tolist())
                    continue
                on = (m >= self.masses[0]) & (m <= self.masses[1])
                at = np.flatnonzero(on)
                if len(at) and at[-1] - at[0] + 1 == len(at):
                    yield (i, x, y, z, m[on].tolist(), values(intensities, int(at[0]), int(at[-1]) + 1).tolist())
                elif len(at):
                    yield (i, x, y, z, m[on].tolist(), values(intensities)[on].tolist())


class ImzmlDataSource(DataSource):
    @classmethod
    def name(cls):
        return "imzml"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def read_imzml(spark: SparkSession, path: str, partitions: int = 8, masses: tuple[float, float] | None = None) -> DataFrame:
    """The spectra; with ``masses`` only their peaks from the first to the second mass, and no spectra without one. Switches on the handing over
    of conditions to sources in Python, which holds for the session."""
    from spectrel.runtime import ship

    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ImzmlDataSource)
    reader = spark.read.format("imzml").option("path", path).option("partitions", partitions)
    return (reader if masses is None else reader.option("mz_min", masses[0]).option("mz_max", masses[1])).load()


def read_image(spark: SparkSession, path: str, swap: bool = True, alpha: bool = False) -> DataFrame:
    """y, x, r, g, b of images in a folder or file; ``swap`` turns the stored BGR order into RGB. With ``alpha`` also a, null where
    the image has no fourth channel."""
    image = spark.read.format("image").load(path).select("image.origin", "image.width", "image.nChannels", "image.data")
    px = F.explode(F.sequence(F.lit(0), (F.length("data") / F.col("nChannels")).cast("int") - 1))
    byte = lambda k: F.conv(F.hex(F.col("data").substr(F.col("i") * F.col("nChannels") + 1 + F.least(F.lit(k), F.col("nChannels") - 1), F.lit(1))), 16, 10).cast("int")
    rows = image.withColumn("i", px)
    r, g, b = (byte(2), byte(1), byte(0)) if swap else (byte(0), byte(1), byte(2))
    return rows.select("origin", F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), (F.col("i") % F.col("width")).alias("x"), r.alias("r"), g.alias("g"), b.alias("b"), *([F.when(F.col("nChannels") == 4, byte(3)).alias("a")] if alpha else []))


def first_image(folder: str, stem: str) -> str | None:
    """The first that exists of .jpg, .jpeg, .tif, .png."""
    return next((p for e in (".jpg", ".jpeg", ".tif", ".png") if os.path.exists(p := os.path.join(folder, stem + e))), None)


def sample_data(spark: SparkSession, n_samples: int = 80, n_features: int = 100, seed: int = 0) -> DataFrame:
    """id, v, x, y: normal features and uniform coordinates, seeded by row."""
    def run(batches):
        import pandas as pd

        for pdf in batches:
            made = [(r.normal(size=n_features), r.random(2)) for r in (np.random.default_rng([seed, int(i)]) for i in pdf["id"])]
            yield pd.DataFrame({"id": pdf["id"], "v": [m[0] for m in made], "x": [m[1][0] for m in made], "y": [m[1][1] for m in made]})

    return spark.range(n_samples).mapInPandas(run, "id long, v array<double>, x double, y double")


def sample_edges(samples: DataFrame, k: int = 4) -> DataFrame:
    """src, dst, w: the symmetric adjacency of the samples' k nearest others, weight 1, no loops."""
    return graph.symmetric(graph.knn(samples.select("id", "x", "y"), k, with_self=False))


def write_map(df: DataFrame, path: str, single: bool = False) -> DataFrame:
    """CSV with a header; gives the frame back."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)
    return df


def write_annotations(df: DataFrame, path: str) -> None:
    """x, y without a header, a folder per image and structure; none for those without points."""
    df.select("image", "structure", "x", "y").write.mode("overwrite").partitionBy("image", "structure").csv(path)
