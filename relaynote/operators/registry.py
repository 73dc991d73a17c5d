"""A registry of ids that lasts from run to run: the first registration of an id counts, later attempts are rejected.

Ids lie in the buckets of a versioned table, and each bucket has pages of a Bloom filter. An increment first asks the
pages, which are a small part of the ids' bytes, and then reads only buckets that may hold one of its ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.versions import Versions, written

#: Bits of a page, as Spark's bitmap functions have it, and bits that an id sets.
PAGE, HASHES = 32768, 2


class Registry:
    """First registrations under `path`, by the columns `key` (name and type), in buckets with `pages` filter pages each.

    A page holds about 3,000 ids before one in thirty of others passes it: take so many pages as buckets have thousands of
    ids to come. Beyond, results stay right and more buckets are read.
    """

    def __init__(self, spark: SparkSession, path: str, key: dict[str, str], buckets: int = 32, pages: int = 4) -> None:
        columns = ", ".join(f"{c} {t}" for c, t in key.items())
        schemas = {"registered": f"{columns}, seq long", "rejected": f"{columns}, seq long, times long", "blooms": "bucket_id int, page int, bitmap binary"}
        self.key, self.pages, self.versions = [*key], pages, Versions(spark, path, [*key], schemas, buckets)

    def _bits(self, ids: DataFrame) -> DataFrame:
        """A row for each bit of each id: key, bucket_id, page, bit."""
        place = lambda k: F.pmod(F.xxhash64(*self.key, F.lit(k)), F.lit(self.pages * PAGE))
        rows = ids.select(*self.key, self.versions.bucket().alias("bucket_id"), F.explode(F.array(*[place(k) for k in range(HASHES)])).alias("place"))
        return rows.select(*self.key, "bucket_id", F.floor(F.col("place") / PAGE).cast("int").alias("page"), (F.col("place") % PAGE).alias("bit"))

    @staticmethod
    def _is_set(bitmap: str, bit: str) -> Column:
        byte = F.conv(F.hex(F.substring(F.col(bitmap), F.floor(F.col(bit) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.call_function("shiftright", byte, (F.col(bit) % 8).cast("int")).bitwiseAND(F.lit(1)) == 1

    def _possible(self, ids: DataFrame, manifest: dict) -> DataFrame:
        """The ids that a page says may be registered: all their bits are set."""
        pages = self.versions.read("blooms", manifest=manifest)
        hit = self._bits(ids).join(pages, ["bucket_id", "page"]).filter(self._is_set("bitmap", "bit"))
        return hit.groupBy(*self.key).agg(F.count("*").alias("set")).filter(F.col("set") == HASHES).select(*self.key)

    def register(self, attempts: DataFrame, batch: int, writer: str = "registry") -> bool:
        """Register a batch of attempts (key, seq); of an id's attempts in a batch the least seq is the first.

        False if the batch was registered before. Attempts with a null in the key are rejected. Equal attempts count each.
        Attempts of an id are counted by partial aggregates and never gathered, however many they are.
        """
        if self.versions.seen(writer, batch):
            return False
        tries = written(attempts.groupBy(*self.key, F.col("seq").cast("long").alias("seq")).agg(F.count("*").alias("n")), "attempts")
        whole = F.lit(True)
        for c in self.key:
            whole = whole & F.col(c).isNotNull()
        firsts = written(tries.filter(whole).groupBy(*self.key).agg(F.min("seq").alias("first")), "firsts")

        def change(manifest: dict) -> dict[str, tuple[DataFrame, bool]]:
            possible = written(self._possible(firsts, manifest), "possible")
            held = self.versions.read("registered", self.versions.touched(possible), manifest)
            self.read_buckets = self.versions.read_buckets
            known = held.select(*self.key).join(possible, self.key, "left_semi")
            new = written(firsts.join(known, self.key, "left_anti"), "new")
            judged = tries.join(new.withColumnRenamed("first", "won"), self.key, "left")
            times = F.col("n") - F.coalesce((F.col("won") == F.col("seq")).cast("long"), F.lit(0))
            rejected = judged.select(*self.key, "seq", times.alias("times")).filter("times > 0")
            bits = self._bits(new).groupBy("bucket_id", "page").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
            changed = [r["bucket_id"] for r in bits.select("bucket_id").distinct().collect()]  # as many as there are buckets at most
            pages = self.versions.read("blooms", changed, manifest).unionByName(bits).groupBy("bucket_id", "page").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
            return {"registered": (new.select(*self.key, F.col("first").alias("seq")), False), "rejected": (rejected, False), "blooms": (pages, True)}

        return self.versions.commit(writer, batch, change)

    def registered(self) -> DataFrame:
        return self.versions.read("registered")

    def rejected(self) -> DataFrame:
        """key, seq and times of the attempts that came too late, of all batches."""
        return self.versions.read("rejected")
