"""Structured Streaming: files are independent, so each micro-batch is a check of its own and no state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.findings import check, selected
from ..operators.project import Config
from ..rules.model import Rule


def check_stream(files: DataFrame, rules: list[Rule], output: str, checkpoint: str, config: Config | None = None, available_now: bool = False) -> StreamingQuery:
    """Writes findings of a streaming ``files`` (file_id, path, lang, src) as Parquet below ``output``, a folder a batch.

    A batch that runs again after a failure replaces its folder, so each file's findings are there once.
    """
    selected(rules, config)  # says at once what doesn't compile

    def one(batch: DataFrame, epoch: int) -> None:
        check(batch, rules, config).write.mode("overwrite").parquet(f"{output}/batch={epoch}")

    writer = files.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
