"""Scores of arriving documents against a fixed reference set with a frozen idf table (an extension: the batch operators
read complete inputs)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from matchloom.operators.corpus import build_corpus
from matchloom.operators.scoring import TopN, sparse_scores
from matchloom.operators.tfidf import CorporaTfidfVectorizer


def score_batch(docs: DataFrame, vectorizer: CorporaTfidfVectorizer, refs: DataFrame, text: str, id_col: str, n: int | None = None) -> DataFrame:
    weights = vectorizer.transform(build_corpus(docs, [text], id_col))
    scores = sparse_scores(refs, weights).where(F.col("score") > 0)
    return TopN(n)(scores) if n else scores


def stream_scores(docs: DataFrame, vectorizer: CorporaTfidfVectorizer, refs: DataFrame, path: str, checkpoint: str, text: str = "text", id_col: str = "doc_id", n: int | None = None) -> StreamingQuery:
    """Starts a query that writes the scores of each micro-batch as Parquet, once per batch id."""

    def write(batch: DataFrame, batch_id: int) -> None:
        score_batch(batch, vectorizer, refs, text, id_col, n).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
