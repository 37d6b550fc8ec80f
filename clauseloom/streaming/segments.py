"""Documents as a stream: each micro-batch goes through the batch parse."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from clauseloom.plans.parse import parse_documents
from clauseloom.sources.documents import check_requests, routed, spread


def segment_stream(docs: DataFrame, out: str, checkpoint: str, check=check_requests, form: str = "parquet", **trigger: object) -> StreamingQuery:  # noqa: ANN001
    """Writes ``out/segments`` and ``out/rejects`` for a stream of (doc_id, file_name, text).

    Documents don't depend on each other, so there is no state. A batch writes into folders named by its
    number and overwrites them when it runs again, so each document's rows are there once.
    """

    def run(batch: DataFrame, number: int) -> None:
        accepted, rejects = routed(check(spread(batch)))
        parse_documents(accepted).write.mode("overwrite").format(form).save(f"{out}/segments/batch={number}")
        rejects.write.mode("overwrite").format(form).save(f"{out}/rejects/batch={number}")

    return docs.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
