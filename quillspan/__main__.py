"""python -m quillspan FOLDER WORD...: the best documents of FOLDER/documents.parquet for the words, with a snippet each."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from .functions import text as t
from .operators import retrieve
from .sources.readers import spread, table


def main(args: list[str]) -> int:
    if len(args) < 2:
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("quillspan").getOrCreate()
    docs = spread(table(spark, args[0], "documents"))
    words = retrieve.query_terms(" ".join(args[1:]))
    hits = retrieve.bm25_scan(docs, "doc_id", t.ascii_tokens("text"), words, 10)
    for r in docs.join(hits, "doc_id").select("doc_id", "score", t.snippet("text").alias("snippet")).orderBy("score", ascending=False).collect():
        print(f"{r['score']:.3f}  {r['doc_id']}  {r['snippet']}")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
