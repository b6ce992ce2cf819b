"""The corpus walk over files that the pages make: a hand-kept folder, and indexed folders with archives, restricted rows and missing files."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.sources.files import INDEX_COLUMNS
from tessel.sources.shared import new_folder
from tessel.sources.walk import _store, corpus_walk


def _put(rows: DataFrame, root: str) -> None:
    """rows: file, and members (name, content); one without a name is the file, else they are put into an archive. Written by tasks, in one step each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                out = io.BytesIO()
                if r["members"][0]["name"] is None:
                    out.write(r["members"][0]["content"].encode())
                else:
                    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                        for m in r["members"]:
                            z.writestr(m["name"], m["content"])
                store, inner, _ = _store(f"{root}/{r['file']}")
                store.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(inner) as f:
                    f.write(out.getvalue())
            yield pa.record_batch([b.column("file")], names=["file"])

    rows.mapInArrow(run, "file string").write.format("noop").mode("overwrite").save()


def corpus_of_pages(spark, d):
    """A quarter of the pages is in the hand-kept folder, a quarter as indexed files, a quarter in archives of at most ten; of the last quarter half of the index rows name
    no file, half one that is missing. The manifest of all of them."""
    root = new_folder(spark, "corpus")
    p = spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.coalesce("html", F.lit("")).alias("content"))
    whole = F.array(F.struct(F.lit(None).cast("string").alias("name"), "content"))
    own = F.format_string("own/48500.00000%d-2026-0%d/%s-%d.html", F.col("page_id") % 5, F.col("page_id") % 5, F.when(F.col("page_id") % 8 == 0, "Voto").otherwise("page"), "page_id")
    at = F.format_string("docs/c%d/p_%d/", F.col("page_id") % 3, F.col("page_id") % 3)
    archive = F.format_string("z%d.zip", F.floor(F.col("page_id") / 120))
    name = F.when(F.col("page_id") % 4 == 2, archive).when(F.col("page_id") % 8 == 3, "").otherwise(F.format_string("%d.html", "page_id"))
    one = p.withColumns({"at": at, "name": name})
    _put(one.where("page_id % 4 = 0").select(own.alias("file"), whole.alias("members")), root)
    _put(one.where("page_id % 4 = 1").select(F.concat("at", "name").alias("file"), whole.alias("members")), root)
    member = F.struct(F.format_string("%d.html", "page_id").alias("name"), "content")
    _put(one.where("page_id % 4 = 2").groupBy(F.concat("at", "name").alias("file")).agg(F.array_sort(F.collect_list(member)).alias("members")), root)
    values = {"processo": F.format_string("p/%d", F.col("page_id") % 3), "arquivo": F.col("name"), "status": F.when(F.col("name") == "", "restrito").otherwise("ok"), "sei": F.when(F.col("page_id") % 4 != 2, F.col("page_id").cast("string")), "tipo_documento": F.lit("Carta")}
    listed = one.where("page_id % 4 <> 0").select("page_id", *[F.coalesce(values.get(c, F.lit("")), F.lit("")).alias(c) for c in INDEX_COLUMNS]).withColumn("part", F.floor(F.col("page_id") / 1200))
    rows = listed.drop("page_id").distinct()
    lines = F.concat_ws("\n", F.lit(";".join(INDEX_COLUMNS)), F.array_sort(F.collect_list(F.concat_ws(";", *INDEX_COLUMNS))))
    index = rows.groupBy(F.concat(F.lit("docs/c"), F.substring("processo", 3, 9), F.lit("/_indice_"), F.col("part"), F.lit(".csv")).alias("file")).agg(lines.alias("content"))
    _put(index.select("file", whole.alias("members")), root)
    out, _ = corpus_walk(spark, root, "own", "docs", ("own", "docs"), {"voto-": "Voto"}, "Desconhecido")
    return out.select("corpus_id", "categoria", "processo", "numero_sei", "tipo_documento", "caminho", "formato", F.coalesce("bytes", F.lit(-1)).alias("bytes"), "sha256", "status_origem", "zip_caminho", "zip_membro", F.coalesce("profundidade", F.lit(0)).alias("profundidade"))


QUERIES = {"corpus_of_pages": corpus_of_pages}
ORACLE = {
    "corpus_of_pages": """WITH p AS (SELECT page_id AS i, coalesce(html, '') AS t, 'docs/c' || page_id % 3 || '/p_' || page_id % 3 || '/' AS dir FROM pages)
SELECT 'own' AS corpus_id, NULL AS categoria, '48500.00000' || i % 5 || '/2026-0' || i % 5 AS processo, NULL AS numero_sei, CASE WHEN i % 8 = 0 THEN 'Voto' ELSE 'Desconhecido' END AS tipo_documento,
  'own/48500.00000' || i % 5 || '-2026-0' || i % 5 || '/' || CASE WHEN i % 8 = 0 THEN 'Voto' ELSE 'page' END || '-' || i || '.html' AS caminho, 'html' AS formato, CAST(octet_length(encode(t)) AS BIGINT) AS bytes, sha256(t) AS sha256,
  'ok' AS status_origem, NULL AS zip_caminho, NULL AS zip_membro, 0 AS profundidade FROM p WHERE i % 4 = 0
UNION ALL SELECT 'docs', 'c' || i % 3, 'p/' || i % 3, CASE WHEN i % 4 <> 2 THEN CAST(i AS VARCHAR) END, 'Carta', CASE WHEN i % 4 = 1 THEN dir || i || '.html' END, CASE WHEN i % 8 <> 3 THEN 'html' END,
  CASE WHEN i % 4 < 3 THEN CAST(octet_length(encode(t)) AS BIGINT) ELSE -1 END, CASE WHEN i % 4 < 3 THEN sha256(t) END, CASE WHEN i % 4 < 3 THEN 'ok' WHEN i % 8 = 3 THEN 'restrito' ELSE 'ausente_no_disco' END,
  CASE WHEN i % 4 = 2 THEN dir || 'z' || i // 120 || '.zip' END, CASE WHEN i % 4 = 2 THEN i || '.html' END, CASE WHEN i % 4 = 2 THEN 1 ELSE 0 END FROM p WHERE i % 4 > 0""",
}
