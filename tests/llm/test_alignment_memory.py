"""Files of chunks and of arrays, whose rows are megabytes each, hold few rows in memory at once."""

from glob import glob

import public_tokenizers
import pyarrow.parquet as pq

from sitewright.llm import alignment
from sitewright.sources.tables import saved

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def groups(table):
    """Rows of each row group of a written table."""
    files = [pq.ParquetFile(f).metadata for f in glob(table._saved_at.removeprefix("file://") + "/*.parquet")]
    return [m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)]


def test_large_rows_stand_in_small_groups(spark):
    table = saved(spark.range(60, numPartitions=1), "large", 8)
    assert max(groups(table)) <= 8 and sum(groups(table)) == table.count() == 60


def test_chunks_and_arrays(spark, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK", 400)
    texts = [(i, f"words number {i} and {i * 7919 % 1000} more of them") for i in range(120)]
    chunks = alignment.aligned_chunks(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1), *PATHS, "doc_id", "text")
    parts = alignment.chunk_parts(chunks)
    index = alignment.pair_index(parts, chunks.count())
    counts = alignment.pair_counts(parts, index, 1)
    assert chunks.count() > alignment.LARGE and parts.count() > alignment.SMALL and index.count() > 4 * alignment.LARGE
    for table, most in ((chunks, alignment.LARGE), (parts, alignment.SMALL), (index, alignment.LARGE), (counts, alignment.LARGE)):
        assert max(groups(table)) <= most
