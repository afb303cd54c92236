"""A chunk index that stays: chunks by product and kind, and an inverted index kept with them, as Parquet in versions.

    chunks/v=N/product_id=P/kind=K/bucket=B   chunks of the partitions that version N changed
    words/v=N/tb=T                            postings of the chunks that are new in N: term, id, tf, dl
    runs/v=N/tb=T                             their unbroken stretches of address and content, for the line search
    gone/v=N                                  chunks whose earlier postings no longer count
    manifests/v=N                             what is live in version N

A version's manifest is written last, as one file; until it is there, readers see the version before, and a second try
writes the same folders again. An upsert rewrites the buckets that it touches and appends the postings of new and changed
chunks only; ``compact`` brings segments together. One writer at a time.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.text import RUN, WORD
from .delta import latest

KEY, PLACE = ["product_id", "kind", "id"], ["product_id", "kind", "bucket"]
MANIFEST = "part string, folder string, product_id string, kind string, bucket int, n long, words long"
POSTING = "product_id string, kind string, id string, since int, dl int, term string, tf int, v int, tb int"
GONE = "product_id string, kind string, id string, since int, v int"


class ChunkIndex:
    """The index in folder ``path`` of a store that driver and executors share.

    ``buckets``: parts of a product's kind, by hash of the chunk's id; ``term_buckets``: parts of the postings; ``spread``: tasks that
    share a part when it is written, so that a frequent term isn't one task's. The first two stay as they are when the index
    is made. The driver holds the manifest: a row for each live product, kind and bucket, and for each segment.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 8, term_buckets: int = 16, spread: int = 4):
        self.spark, self.path, self.buckets, self.term_buckets, self.spread = spark, path.rstrip("/"), buckets, term_buckets, spread

    def version(self) -> int:
        """The last version whose manifest is there; 0 where there is none."""
        try:
            return self.spark.read.parquet(f"{self.path}/manifests").agg(F.max("v")).first()[0] or 0
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return 0
            raise

    def manifest(self) -> list:
        v = self.version()
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifests/v={v}").collect() if v else []

    def _read(self, part: str, folders: list[str], schema: str) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{part}").parquet(*folders)

    def _chunks(self, manifest: list) -> DataFrame | None:
        folders = [r.folder for r in manifest if r.part == "chunks"]
        if not folders:
            return None
        own = self.spark.read.option("mergeSchema", "true").parquet(*folders).schema
        schema = T.StructType([*own.fields, *T._parse_datatype_string("v int, product_id string, kind string, bucket int").fields])
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/chunks").parquet(*folders).drop("v")

    def chunks(self) -> DataFrame:
        """Live chunks; conditions on product_id, kind and bucket choose folders. ``since``: the version their postings are of."""
        df = self._chunks(self.manifest())
        if df is None:
            raise ValueError(f"no index in {self.path}")
        return df

    def statistics(self, kinds: list[str] | None = None) -> tuple[int, float]:
        """Number of chunks and mean number of words, from the manifest."""
        own = [r for r in self.manifest() if r.part == "chunks" and (kinds is None or r.kind in kinds)]
        n = sum(r.n for r in own)
        return n, sum(r.words for r in own) / max(n, 1)

    def postings(self, part: str = "words", kinds: list[str] | None = None, most_broadcast: int = 1_000_000) -> DataFrame:
        """(product_id, kind, id, since, dl, term, tf, tb) of live chunks; ``part``: words or runs. Conditions on tb choose folders."""
        m = self.manifest()
        rows = self._read(part, [r.folder for r in m if r.part == part], POSTING)
        gone = self._read("gone", [r.folder for r in m if r.part == "gone"], GONE)
        if kinds is not None:
            rows, gone = rows.where(F.col("kind").isin(kinds)), gone.where(F.col("kind").isin(kinds))
        n = sum(r.n for r in m if r.part == "gone")
        if n:
            gone = gone.select(F.col("product_id").alias("p"), F.col("kind").alias("k"), F.col("id").alias("i"), F.col("since").alias("s"))
            same = rows.product_id.eqNullSafe(gone.p) & (rows.kind == gone.k) & (rows.id == gone.i) & (rows.since == gone.s)
            rows = rows.join(F.broadcast(gone) if n <= most_broadcast else gone, same, "left_anti")
        return rows.drop("v")

    def bucket_of_term(self, term):
        return F.pmod(F.xxhash64(term), F.lit(self.term_buckets)).cast("int")

    def _write(self, part: str, v: int, rows: DataFrame, *by: str) -> str:
        folder = f"{self.path}/{part}/v={v}"
        out = rows.write.mode("overwrite")
        (out.partitionBy(*by) if by else out).parquet(folder)
        return folder

    def apply(self, upserts: DataFrame | None = None, deletes: DataFrame | None = None) -> int:
        """Puts ``upserts`` in place of the chunks of their product, kind and id, takes ``deletes`` (product_id, id) away; the new version.

        ``upserts``: id, product_id, kind, uri, content[, path] and any other columns; of several rows of one chunk the last by all columns counts. Chunks
        whose address and content are as before keep their postings. Null kinds are text; a null product is one of its own.
        """
        before, v = self.manifest(), self.version() + 1
        bucket = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(self.buckets)).cast("int")
        new = None
        if upserts is not None:
            path = F.col("path") if "path" in upserts.columns else F.lit(None).cast("string")
            new = upserts.withColumns({"id": F.col("id").cast("string"), "product_id": F.col("product_id").cast("string"), "kind": F.coalesce("kind", F.lit("text")), "path": path, "content": F.coalesce("content", F.lit(""))})
            new = latest(new, KEY, F.to_json(F.struct(*new.columns)).desc())
            text = F.concat_ws("\n", "uri", F.coalesce("path", F.lit("")), "content")
            new = new.withColumns({"bucket": bucket, "hash": F.xxhash64(text), "dl": F.size(F.regexp_extract_all(F.lower("content"), F.lit(f"({WORD})"), 1))})
        taken = None
        if deletes is not None:
            taken = deletes.select(F.col("product_id").cast("string").alias("p"), F.col("id").cast("string").alias("i")).distinct()
        touched = [d.select("product_id", "kind", "bucket") for d in ([new] if new is not None else [])]
        if taken is not None:
            b = F.pmod(F.xxhash64("i"), F.lit(self.buckets)).cast("int")
            touched.append(taken.select(F.col("p").alias("product_id"), F.explode(F.array(*[F.lit(k) for k in sorted({r.kind for r in before if r.part == "chunks"} or {"text"})])).alias("kind"), b.alias("bucket")))
        places = {tuple(r) for t in touched for r in t.distinct().collect()}  # manifest rows
        old = self._chunks([r for r in before if r.part == "chunks" and (r.product_id, r.kind, r.bucket) in places])
        same = lambda a, b: a.product_id.eqNullSafe(b.p) & (a.id == b.i)
        known = None
        if old is not None:
            known = old.select(F.col("product_id").alias("p"), F.col("kind").alias("k"), F.col("id").alias("i"), F.col("hash").alias("h"), F.col("since").alias("s"))
        if new is not None:
            if known is not None:
                new = new.join(known, same(new, known) & (new.kind == known.k), "left")
                new = new.withColumn("since", F.when(F.col("hash") == F.col("h"), F.col("s")).otherwise(v).cast("int")).drop("p", "k", "i", "h", "s")
            else:
                new = new.withColumn("since", F.lit(v).cast("int"))
        rows = new
        if old is not None:
            left = old.join(taken, same(old, taken), "left_anti") if taken is not None else old
            if new is not None:
                mine = new.select(F.col("product_id").alias("p"), F.col("kind").alias("k"), F.col("id").alias("i"))
                left = left.join(mine, same(left, mine) & (left.kind == mine.k), "left_anti").unionByName(new, allowMissingColumns=True)
            rows = left
        made: list[tuple] = []
        if rows is not None:
            folder = self._write("chunks", v, rows.repartition(*PLACE), *PLACE)
            files = self.spark.read.schema(T.StructType([*[f for f in rows.schema.fields if f.name not in PLACE], *T._parse_datatype_string("product_id string, kind string, bucket int").fields])).parquet(folder)
            stats = files.groupBy(*PLACE).agg(F.min("_metadata.file_path").alias("file"), F.count("*").alias("n"), F.sum("dl").alias("words")).collect()
            made = [("chunks", unquote(r.file.rpartition("/")[0]), r.product_id, r.kind, r.bucket, r.n, int(r.words)) for r in stats]
            # from what is written, so a second try of a task sees the same
            fresh = files.where(F.col("since") == v)
            made += [self._append("words", v, fresh, F.regexp_extract_all(F.lower("content"), F.lit(f"({WORD})"), 1)),
                     self._append("runs", v, fresh, F.regexp_extract_all(F.lower(F.concat_ws("\n", "uri", F.coalesce("path", F.lit("")), "content")), F.lit(f"({RUN})"), 1))]
            if known is not None:
                now = files.select("product_id", "kind", "id", "since")
                lost = known.join(now, now.product_id.eqNullSafe(known.p) & (now.kind == known.k) & (now.id == known.i) & (now.since == known.s), "left_anti")
                folder = self._write("gone", v, lost.select(F.col("p").alias("product_id"), F.col("k").alias("kind"), F.col("i").alias("id"), F.col("s").alias("since")))
                made.append(("gone", folder, None, None, None, self.spark.read.schema(GONE).parquet(folder).count(), 0))
        kept = [tuple(r) for r in before if r.part != "chunks" or (r.product_id, r.kind, r.bucket) not in places]
        self._commit(v, kept + made)
        return v

    def _append(self, part: str, v: int, fresh: DataFrame, terms) -> tuple:
        spread = F.pmod(F.xxhash64("id"), F.lit(self.spread))
        each = fresh.select("product_id", "kind", "id", "since", "dl", F.explode(terms).alias("term")).withColumns({"tb": self.bucket_of_term(F.col("term")), "_s": spread})
        # one shuffle: counts are made where the files are written
        each = each.repartition("tb", "_s").groupBy("tb", "_s", "product_id", "kind", "id", "since", "dl", "term").agg(F.count("*").cast("int").alias("tf"))
        return part, self._write(part, v, each.drop("_s").sortWithinPartitions("tb", "term"), "tb"), None, None, None, 0, 0

    def _commit(self, v: int, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifests/v={v}")

    def compact(self) -> int:
        """Live postings in one segment each, nothing gone; chunks stay where they are."""
        before, v = self.manifest(), self.version() + 1
        made = [tuple(r) for r in before if r.part == "chunks"]
        for part in ("words", "runs"):
            rows = self.postings(part).withColumn("_s", F.pmod(F.xxhash64("id"), F.lit(self.spread))).repartition("tb", "_s").drop("_s")
            made.append((part, self._write(part, v, rows.sortWithinPartitions("tb", "term"), "tb"), None, None, None, 0, 0))
        self._commit(v, made)
        return v
