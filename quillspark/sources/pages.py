"""Items of pages as JSON files that a manifest names: read by manifest, written page by page.

A folder holds one folder for each document, with `translation-manifest.json` and a file for each page: a JSON array of items. Spark reads the manifests, so planning
is distributed, and deals their entries to tasks; a task reads one page's file at a time.

Writing touches the pages that have rows and no others. Page files get names of their own and are written by tasks dealt by document and page, then each touched
document's manifest is replaced by one that names the new files beside the untouched old ones. A manifest is renamed into place, so readers see a document as it
was before or after, and a task that is lost and run again leaves at most files that nobody names. Documents are replaced one by one.

Paths are those of Spark for the manifests and of pyarrow's file systems (file, hdfs, s3, gs) for page files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark import rounds
from quillspark.package import ship

# The manifest's name and schema.
NAME, SCHEMA, VERSION = "translation-manifest.json", "translation_manifest_v1", 1
ITEMS = "document_id string, page_index long, pos int, item string"


def store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it."""
    return pafs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (pafs.LocalFileSystem(), path)


def inside(root: str, document_id: str) -> tuple[pafs.FileSystem, str]:
    fs, at = store(root)
    return fs, f"{at}/{quote(document_id, safe='')}"


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """document_id, folder (its name, the id quoted as in a URL), text: the manifests under a folder."""
    folder = F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), rf"([^/]*)/{NAME}$", 1))
    return spark.read.text(f"{root}/*/{NAME}", wholetext=True).select(F.url_decode(folder).alias("document_id"), folder.alias("folder"), F.col("value").alias("text"))


def entries(spark: SparkSession, root: str, strict: bool = True) -> DataFrame:
    """document_id, folder, page_index, path: the pages that manifests name.

    A manifest of another schema, without a list of pages, with an entry that has no index or no path, or with one index twice, is an error. With
    strict=False such entries and manifests are passed over, and of entries with one index the last counts.
    """
    page = "struct<page_index: bigint, path: string>"
    read = F.from_json("text", f"schema string, pages array<{page}>")
    m = manifests(spark, root).withColumn("m", read)
    path = lambda p: F.trim(F.coalesce(p["path"], F.lit("")))
    good = (F.col("m.schema") == SCHEMA) & F.col("m.pages").isNotNull()
    if not strict:
        e = m.where(good).select("document_id", "folder", F.posexplode("m.pages").alias("at", "p")).where("p.page_index is not null").where(path(F.col("p")) != "")
        return e.groupBy("document_id", "folder", F.col("p.page_index").alias("page_index")).agg(F.max_by(path(F.col("p")), "at").alias("path"))
    indexes = F.transform("m.pages", lambda p: p["page_index"])
    why = F.coalesce(
        F.when(~F.coalesce(F.col("m.schema") == SCHEMA, F.lit(False)), F.concat(F.lit("Unsupported manifest schema: "), F.coalesce("m.schema", F.lit("<missing>")))), F.when(F.col("m.pages").isNull(), "Invalid manifest pages"),
        F.when(F.exists("m.pages", lambda p: p.isNull() | p["page_index"].isNull()), "Invalid manifest page entry"), F.when(F.exists("m.pages", lambda p: path(p) == ""), "Manifest page is missing path"),
        F.when(F.size(F.array_distinct(indexes)) < F.size(indexes), "Duplicate manifest page index"),
    )
    checked = F.when(why.isNull(), F.col("m.pages")).otherwise(F.raise_error(F.concat(why, F.lit(" in "), "folder")).cast(f"array<{page}>"))
    return m.select("document_id", "folder", F.explode(checked).alias("p")).select("document_id", "folder", "p.page_index", path(F.col("p")).alias("path"))


def read(spark: SparkSession, root: str, strict: bool = True, partitions: int | None = None) -> DataFrame:
    """ITEMS: each item of each page, as JSON, in its place (from 0). A page's file that isn't a JSON array is an error."""
    ship(spark)
    e = entries(spark, root, strict)

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                apart = r["path"].startswith("/") or ":" in r["path"].split("/")[0]
                fs, at = store(r["path"] if apart else root)
                with fs.open_input_stream(at if apart else f"{at}/{r['folder']}/{r['path']}") as f:
                    items = json.loads(f.read())
                if not isinstance(items, list):
                    raise ValueError(f"no list of items in {r['folder']}/{r['path']}")
                n = len(items)
                yield pa.RecordBatch.from_pydict({
                    "document_id": pa.array([r["document_id"]] * n, pa.string()), "page_index": pa.array([r["page_index"]] * n, pa.int64()), "pos": pa.array(range(n), pa.int32()),
                    "item": pa.array([json.dumps(x, ensure_ascii=False, separators=(",", ":")) for x in items], pa.string()),
                })

    dealt = e.repartition(partitions or spark.sparkContext.defaultParallelism * 4, "document_id", "page_index")
    return dealt.mapInArrow(pages, ITEMS)


def write(items: DataFrame, root: str) -> DataFrame:
    """Write the pages of items (ITEMS); document_id, page_index and path of each page that was written. Pages without rows stay as they are."""
    ship(items.sparkSession)

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by page; an open page ends where another begins."""
        key, texts, out = None, [], []

        def close() -> None:
            name = f"page-{key[1]:05d}-{uuid.uuid4().hex}.json"
            fs, folder = inside(root, key[0])
            fs.create_dir(folder, recursive=True)
            with fs.open_output_stream(f"{folder}/{name}") as f:
                f.write(("[\n" + ",\n".join(texts) + "\n]\n").encode())
            out.append((*key, name))

        for batch in batches:
            for r in batch.to_pylist():
                if (at := (r["document_id"], r["page_index"])) != key:
                    if key is not None:
                        close()
                    key, texts = at, []
                texts.append(r["item"])
        if key is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.string())], names=["document_id", "page_index", "path"])

    by = ["document_id", "page_index"]
    rows = items.select(*by, "pos", "item").where("document_id is not null and page_index is not null and item is not null")
    made = rounds.written(rows.repartition(*by).sortWithinPartitions(*by, "pos", "item").mapInArrow(pages, "document_id string, page_index long, path string"), "pages")

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                fs, folder = inside(root, r["document_id"])
                known: dict[int, str] = {}
                if fs.get_file_info(f"{folder}/{NAME}").type == pafs.FileType.File:
                    with fs.open_input_stream(f"{folder}/{NAME}") as f:
                        known = {p["page_index"]: p["path"] for p in json.loads(f.read())["pages"]}
                known |= {p["page_index"]: p["path"] for p in r["pages"]}
                listed = [{"page_index": i, "page_number": i + 1, "path": known[i]} for i in sorted(known)]
                staged = f"{folder}/.{uuid.uuid4().hex}"
                with fs.open_output_stream(staged) as f:
                    f.write(json.dumps({"schema": SCHEMA, "schema_version": VERSION, "pages": listed}, ensure_ascii=False, indent=2).encode())
                fs.move(staged, f"{folder}/{NAME}")
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(batch)], pa.int64())})

    touched = made.groupBy("document_id").agg(F.collect_list(F.struct("page_index", "path")).alias("pages"))
    touched.mapInArrow(commit, "n long").agg(F.sum("n")).collect()
    return made
