"""Maps of images: built in sessions, kept as versioned tables, queried by descriptors."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, fields
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from lodestar.operators import bow, imaging, vlad
from lodestar.operators.knn import few, hamming_knn, knn, ratio_test
from lodestar.sources.shared import kept


@dataclass
class Settings:
    """What a map's header holds besides its versions.

    merge: none, and, or; applied to the bits of matched words. resize_factor and created
    describe how images were prepared and when the map began; attributes are the caller's.
    """

    method: str = "ibow"
    ratio_ingest: float = 0.8
    ratio_query: float = 0.65
    merge: str = "none"
    purge: bool = True
    min_postings: int = 3
    resize_factor: float = 0.53333
    created: str = field(default_factory=lambda: datetime.now(UTC).isoformat(timespec="seconds"))
    attributes: dict = field(default_factory=dict)


class _Store:
    """Tables of one map below ``path``, a folder that all executors share.

    A commit writes new tables into a folder of their own and then a numbered header that
    names them; what has no header does not count, so a failed commit leaves the map as it
    was, and of two writers that start from one version the second fails. The last
    ``KEPT`` versions stay readable, older ones are removed. The header also holds the last
    committed batch of each source, so that a batch that comes again changes nothing.
    """

    KEPT = 2

    def __init__(self, spark: SparkSession, path: str, settings: Settings, read_only: bool = False):
        self.spark, self.path, self.settings, self.read_only = spark, path.rstrip("/"), settings, read_only
        self.number, self.folders, self.batches = 0, {}, {}

    @property
    def empty(self) -> bool:
        return not self.folders

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self.folders[name]}/{name}")

    def has(self, name: str) -> bool:
        return name in self.folders

    def seen(self, batch: int | None, source: str) -> bool:
        return batch is not None and self.batches.get(source, -1) >= batch

    def _writable(self) -> None:
        if self.read_only:
            raise NotImplementedError("this map was opened for queries")

    def _commit(self, batch: int | None, source: str, **tables: DataFrame) -> None:
        folder = f"tables-{self.number + 1}-{uuid.uuid4().hex[:12]}"
        for name, df in tables.items():
            df.write.parquet(f"{self.path}/{folder}/{name}")
        folders = self.folders | dict.fromkeys(tables, folder)
        batches = self.batches | ({} if batch is None else {source: batch})
        header = json.dumps({"settings": asdict(self.settings), "folders": folders, "batches": batches})
        self.spark.createDataFrame([(header,)], "value string").coalesce(1).write.mode("errorifexists").text(f"{self.path}/headers/{self.number + 1}")
        self.number, self.folders, self.batches = self.number + 1, folders, batches
        self._forget()

    def _forget(self) -> None:
        """Remove headers before the last KEPT, and table folders that no header left names; of later numbers, other writers' work, none."""
        files = _files(self.spark, self.path)
        live = set()
        for number in _versions(self.spark, self.path):
            if number <= self.number - self.KEPT:
                files.remove(f"{self.path}/headers/{number}")
            else:
                live |= set(_header(self.spark, self.path, number)["folders"].values())
        for name in files.names(self.path):
            if name.startswith("tables-") and name not in live and int(name.split("-")[1]) <= self.number:
                files.remove(f"{self.path}/{name}")

    def _opened(self, number: int) -> _Store:
        header = _header(self.spark, self.path, number)
        self.number, self.folders, self.batches = number, header["folders"], header["batches"]
        return self

    def described(self, found: DataFrame, image: str = "image_id") -> DataFrame:
        """Rows with an image id, and what the map knows of that image; unknown images get nulls."""
        return found.join(self.table("metadata").withColumnRenamed("image_id", image), image, "left") if self.has("metadata") else found

    def _metadata(self, new: DataFrame | None) -> dict[str, DataFrame]:
        """The metadata table to write, if any came: one row an image; a later one replaces an earlier one."""
        if new is None:
            return {}
        if not self.has("metadata"):
            return {"metadata": new}
        return {"metadata": self.table("metadata").join(new, "image_id", "left_anti").unionByName(new, allowMissingColumns=True)}


class _files:
    """The few file-system calls that a store needs, through Hadoop, for whatever path Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(folder))] if self.exists(folder) else []

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def remove(self, path: str) -> None:
        self._fs.delete(self._path(path), True)


def _versions(spark: SparkSession, path: str) -> list[int]:
    files = _files(spark, path)
    return sorted(int(n) for n in files.names(f"{path}/headers") if n.isdigit() and files.exists(f"{path}/headers/{n}/_SUCCESS"))


def _header(spark: SparkSession, path: str, number: int) -> dict:
    return json.loads(spark.read.text(f"{path}/headers/{number}").first().value)


def load_map(spark: SparkSession, path: str, read_only: bool = False, number: int | None = None) -> PlaceMap | VladMap:
    """The map at ``path``, of the kind that its header names, in its last or the given version; read_only refuses training."""
    path = path.rstrip("/")
    versions = _versions(spark, path)
    if not versions or (number is not None and number not in versions):
        raise ValueError(f"no map at {path}" + ("" if number is None else f" of version {number}"))
    number = versions[-1] if number is None else number
    known = {f.name for f in fields(Settings)}
    settings = Settings(**{k: v for k, v in _header(spark, path, number)["settings"].items() if k in known})
    kinds = {"ibow": PlaceMap, "vlad": VladMap}
    if settings.method not in kinds:
        raise ValueError(f"{settings.method} is no kind of map")
    return kinds[settings.method](spark, path, settings, read_only=read_only)._opened(number)


class PlaceMap(_Store):
    """Words (word_id, bits, first_image), postings (word_id, image_id, kp_ind), images, and if given metadata and keyframes.

    Descriptors are 64 bits (long) or more (array of longs), of one kind in a map.
    """

    def __init__(self, spark: SparkSession, path: str, settings: Settings | None = None, read_only: bool = False):
        super().__init__(spark, path, settings or Settings(), read_only)

    def add(self, features: DataFrame, metadata: DataFrame | None = None, keyframes: DataFrame | None = None, batch: int | None = None, source: str = "stream") -> bool:
        """One batch of images (image_id, kp_ind, bits): matched against the committed map, then purged. False if the batch was committed before.

        Images of one batch do not see each other's words; a batch of one image is the
        strict sequential ingest. Features without bits are left out, and so are images
        without features. metadata has image_id and what queries shall return; keyframes
        (image_id, position) says where images stand in their recording.
        """
        self._writable()
        if self.seen(batch, source):
            return False
        s = self.settings
        features = kept(features.where("bits is not null").select("image_id", "kp_ind", "bits"))
        new_images = features.select("image_id").distinct()
        if keyframes is not None:
            keyframes = keyframes.join(new_images, "image_id", "left_semi").select("image_id", "position")
            keyframes = self.table("keyframes").join(keyframes, "image_id", "left_anti").unionByName(keyframes) if self.has("keyframes") else keyframes
        more = self._metadata(None if metadata is None else metadata.join(new_images, "image_id", "left_semi")) | ({} if keyframes is None else {"keyframes": keyframes})
        if features.isEmpty():
            self._commit(batch, source)
            return True
        if self.empty:
            words = bow.numbered(features, ["image_id", "kp_ind"], 0)
            postings, images = words.select("word_id", "image_id", "kp_ind"), new_images
            words = words.select("word_id", "bits", F.col("image_id").alias("first_image"))
        else:
            old, before = self.table("words"), self.table("postings")
            matched = kept(self._matches(features, s.ratio_ingest)).select("image_id", "kp_ind", "word_id")
            fresh = bow.new_words(features, matched, ["image_id", "kp_ind"])
            last = old.agg(F.max("word_id")).first()[0]
            added = bow.numbered(fresh, ["image_id", "kp_ind"], 0 if last is None else last + 1)
            if s.merge != "none":
                old = _merged(old, matched.join(features, ["image_id", "kp_ind"]), s.merge)
            words = old.unionByName(added.select("word_id", "bits", F.col("image_id").alias("first_image")))
            postings = bow.posting_update(before, matched).unionByName(added.select("word_id", "image_id", "kp_ind"))
            images = self.table("images").union(new_images).distinct()
        if s.purge:
            stay = bow.purge(postings, images, s.min_postings, "word_id").select("word_id")
            words, postings = words.join(stay, "word_id", "left_semi"), postings.join(stay, "word_id", "left_semi")
        self._commit(batch, source, words=words, postings=postings, images=images, **more)
        return True

    def _matches(self, features: DataFrame, ratio: float) -> DataFrame:
        """(image_id, kp_ind, word_id) of the features whose nearest word is clearly nearer than the second."""
        named = features.select(F.struct("image_id", "kp_ind").alias("_f"), "bits")
        found = ratio_test(hamming_knn(named, self.table("words"), 2, "bits", "_f", "word_id"), ratio, "_f")
        return found.select("_f.image_id", "_f.kp_ind", "word_id")

    def delete_words(self, gone: DataFrame) -> None:
        """Words (word_id), and their postings, leave the map."""
        self._writable()
        self._commit(None, "", words=bow.without_words(self.table("words"), gone), postings=bow.without_words(self.table("postings"), gone))

    def query(self, features: DataFrame, n: int = 5, ratio: float | None = None, described: bool = False) -> DataFrame:
        """(query_id, rank, image_id, score): the n best images for each query image of (image_id, kp_ind, bits), all in one plan.

        Equal scores (9 places) rank by image id; queries without a matched word have no
        rows. described adds the images' metadata.
        """
        features = features.where("bits is not null")
        matches = self._matches(features, ratio or self.settings.ratio_query).withColumnRenamed("image_id", "query_id")
        sizes = features.groupBy(F.col("image_id").alias("query_id")).agg(F.count(F.lit(1)).alias("features"))
        scores = bow.tfidf_of_many(matches, self.table("postings"), sizes, self.table("images").count(), "word_id")
        best = bow.top_of_many(scores, n)
        return self.described(best) if described else best

    def stats(self) -> DataFrame:
        """images, words, last_image."""
        i, w = self.table("images"), self.table("words")
        return i.agg(F.count(F.lit(1)).alias("images"), F.max("image_id").alias("last_image")).crossJoin(w.agg(F.count(F.lit(1)).alias("words")))

    def orphans(self) -> DataFrame:
        return bow.integrity(self.table("words"), self.table("postings"), "word_id")


def _merged(words: DataFrame, matched: DataFrame, how: str) -> DataFrame:
    """Words whose bits are joined with those of the features that matched them."""
    fold, both = (F.bit_and, Column.bitwiseAND) if how == "and" else (F.bit_or, Column.bitwiseOR)
    if isinstance(words.schema["bits"].dataType, ArrayType):
        width = words.select(F.size("bits")).first()[0]
        own = matched.groupBy("word_id").agg(F.array(*[fold(F.col("bits")[i]) for i in range(width)]).alias("_m"))
        joined = F.zip_with("bits", "_m", both)
    else:
        own = matched.groupBy("word_id").agg(fold("bits").alias("_m"))
        joined = both(F.col("bits"), F.col("_m"))
    return words.join(own, "word_id", "left").select("word_id", F.when(F.col("_m").isNull(), F.col("bits")).otherwise(joined).alias("bits"), "first_image")


class VladMap(_Store):
    """Codebook (k, center) and encoded images; a session adapts the codebook, rebases what is stored and encodes what is new."""

    def __init__(self, spark: SparkSession, path: str, settings: Settings | None = None, read_only: bool = False):
        super().__init__(spark, path, settings or Settings(method="vlad"), read_only)

    @property
    def codebook(self) -> DataFrame:
        return self.table("centers")

    def set_codebook(self, centers: DataFrame) -> None:
        """Start from these centers; images encoded over others are rebased, which needs the same k."""
        self._writable()
        if self.empty:
            none = self.spark.createDataFrame([], "image_id long, k long, pos int, resid double, n long")
            return self._commit(None, "", centers=few(centers.select(F.col("k").cast("long").alias("k"), "center")), vlad=none)
        centers = centers.select(F.col("k").cast("long").alias("k"), "center")
        same = self.codebook.select("k").exceptAll(centers.select("k")).isEmpty() and centers.count() == self.codebook.count()
        if not same:
            raise ValueError("a new codebook needs the centers that images are encoded over")
        self._commit(None, "", centers=centers, vlad=vlad.rebase(self.table("vlad"), self.codebook, centers))

    def train(self, points: DataFrame, adapt: bool = True, metadata: DataFrame | None = None, batch: int | None = None, source: str = "stream") -> bool:
        """One session of (image_id, vec); False if its batch was committed before."""
        self._writable()
        if self.seen(batch, source):
            return False
        old, stored = self.codebook, self.table("vlad")
        new = old
        if adapt:
            long = vlad.adapt(points, old)
            new = kept(long.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "center"))), lambda t: t["center"]).alias("center")))
        moved = vlad.rebase(stored, old, new)
        encoded = vlad.encode(points, new).select(F.col("image_id").cast("long").alias("image_id"), F.col("k").cast("long").alias("k"), "pos", "resid", "n")
        self._commit(batch, source, centers=new, vlad=moved.unionByName(encoded), **self._metadata(metadata))
        return True

    def _flat(self, encoded: DataFrame) -> DataFrame:
        return vlad.flattened(vlad.normalized(vlad.filled(encoded, self.codebook)))

    def query(self, points: DataFrame, k: int = 5, described: bool = False) -> DataFrame:
        """(query_id, rank, image_id, dist) of the k nearest images by L2 of normalised rows, for each image of (image_id, vec)."""
        base, queries = self._flat(self.table("vlad")), self._flat(vlad.encode(points, self.codebook)).withColumnRenamed("image_id", "query_id")
        best = knn(queries, base, "l2", k, "vec", "query_id", "image_id", 9).select("query_id", "rank", "image_id", "dist")
        return self.described(best) if described else best


def prepared(pixels: DataFrame, width: int, height: int, factor: float = 0.53333, channels: tuple[str, ...] = ("r", "g", "b"), enhance: Callable[[DataFrame], DataFrame] | None = None, mask: DataFrame | None = None) -> DataFrame:
    """Pixels (image, x, y, channels) as features shall be taken from them: resized, balanced to gray, enhanced, masked.

    mask (x, y, keep) is of the resized frame; pixels that it does not keep are left out.
    """
    out = imaging.gray_world(imaging.resize(pixels, factor, width, height, list(channels)), "image", list(channels))
    out = enhance(out) if enhance else out
    return out if mask is None else out.join(F.broadcast(few(mask.where("keep").select("x", "y"), 1 << 24)), ["x", "y"], "left_semi")


def extract(images: DataFrame, extractor: Callable, schema: str) -> DataFrame:
    """Features of image rows by a caller's mapInPandas function; images without any give no rows."""
    return images.mapInPandas(extractor, schema)
