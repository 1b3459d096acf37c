"""Rows that hold on a span of days, written as Parquet with a row for every day."""

from __future__ import annotations

from urllib.parse import urlparse

from pyspark.sql import DataFrame

#: Rows expanded at once, which are one row group of a file: some 50 MB in a Python worker.
ROWS = 500_000


def local_path(path: str) -> str | None:
    """The path of a folder that tasks can open as files; none in a store that only Spark opens."""
    parts = urlparse(path)
    return parts.path if parts.scheme in ("", "file") and parts.netloc in ("", "localhost") else None


def day_source():
    """A data source that writes each row once for every day from ``begins`` to ``ends``, which become the column ``day`` names.

    Spark's writer looks every value of every row up in a dictionary. Here the texts of a batch are encoded once before they are
    repeated. A task writes one file under a hidden name; the commit gives those of the tasks that count their names, so
    what a failed attempt leaves is never read. The class is local so that it travels to the workers by value.
    """
    import os
    import uuid
    from dataclasses import dataclass

    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

    block = ROWS

    def expanded(batch: pa.RecordBatch, day: str):
        """Tables of at most about ``block`` rows, or the days of one row."""
        begins, ends = (batch.column(name).cast(pa.int32()).to_numpy() for name in ("begins", "ends"))
        encoded = pa.table(
            {
                name: column.dictionary_encode() if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column
                for name, column in zip(batch.schema.names, batch.columns)
                if name != "ends"
            }
        )
        place = encoded.schema.get_field_index("begins")
        days = ends.astype(np.int64) - begins + 1
        total, low = np.cumsum(days), 0
        while low < len(days):
            done = total[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(total, done + block, side="right")))
            rows = np.repeat(np.arange(low, high), days[low:high])
            dates = begins[rows] + (np.arange(len(rows)) + done - (total - days)[rows])
            column = pa.array(dates.astype(np.int32)).view(pa.date32())
            yield encoded.take(pa.array(rows)).set_column(place, day, column)
            low = high

    @dataclass
    class Written(WriterCommitMessage):
        name: str | None

    class DayWriter(DataSourceArrowWriter):
        def __init__(self, folder: str, day: str) -> None:
            self.folder, self.day = folder, day

        def hidden(self, name: str) -> str:
            return os.path.join(self.folder, f"_{name}")

        def write(self, iterator) -> Written:
            name, writer = f"part-{uuid.uuid4().hex}.snappy.parquet", None
            try:
                for batch in iterator:
                    for table in expanded(batch, self.day):
                        if writer is None:
                            os.makedirs(self.folder, exist_ok=True)
                            writer = pq.ParquetWriter(self.hidden(name), table.schema, compression="snappy", store_schema=False)
                        writer.write_table(table)
            finally:
                if writer:
                    writer.close()
            return Written(name if writer else None)

        def commit(self, messages) -> None:
            os.makedirs(self.folder, exist_ok=True)
            for message in messages:
                if message and message.name:
                    os.rename(self.hidden(message.name), os.path.join(self.folder, message.name))

        def abort(self, messages) -> None:
            for message in messages:
                if message and message.name:
                    os.remove(self.hidden(message.name))

    class Days(DataSource):
        @classmethod
        def name(cls) -> str:
            return "ledgerspark-days"

        def writer(self, schema, overwrite: bool) -> DayWriter:
            return DayWriter(self.options["path"], self.options["day"])

    return Days


def write_days(steady: DataFrame, folder: str, day: str) -> None:
    """Write ``steady`` to a new local folder, each row once for every day from ``begins`` to ``ends``."""
    source = day_source()
    steady.sparkSession.dataSource.register(source)
    steady.write.format(source.name()).option("day", day).mode("append").save(folder)
