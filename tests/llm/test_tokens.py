"""What the token files hold, seen from their footers, and the encoder against the library."""

import glob
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestone.llm import tokens


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_footers(spark, tmp_path, encoding):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(("stone", "river", "lamp", "quiet", f"w{i}")) for _ in range(200))) for i in range(3000)]
    path = str(tmp_path / encoding)
    tokens.write(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), path, encoding=encoding, row_group_bytes=1 << 20, page_rows=100, page_bytes=16 << 10)
    files = sorted(glob.glob(f"{path}/part=*/*.parquet"))
    groups, groups_rows = 0, []
    for f in files:
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            groups += 1
            groups_rows.append(group.num_rows)
            assert group.total_byte_size < 4 << 20
            for c in range(group.num_columns):
                column = group.column(c)
                # page indexes, and no page of more rows than asked for is hidden behind one entry
                assert column.has_offset_index and column.has_column_index
                if column.path_in_schema.startswith("ids"):
                    if encoding == "dictionary":
                        assert column.has_dictionary_page and any("DICTIONARY" in e for e in column.encodings)
                    else:
                        assert not column.has_dictionary_page and "DELTA_BINARY_PACKED" in column.encodings
    assert sum(groups_rows) == len(rows) and groups >= len(files)
    got = tokens.read(spark, path).where("id = 1234").select("id", "n_tokens", F.size("ids").alias("n")).collect()
    assert len(got) == 1 and got[0]["n"] == got[0]["n_tokens"]


def test_encoder_is_the_library():
    with open(tokens.default_tokenizer(), encoding="utf-8") as f:
        encoder = tokens.Encoder(f.read(), cache_bytes=2_000)
    r = random.Random(4)
    bits = ["a", "The", " ", ".", ",", "\n", "it's", "9", "é", "日本", "\x01", "\x02", " ", "\x1c", "²", "end.", "!", " x", "\n\n", "ß,", ".B", " "]
    texts = [None, "", " ", "  a", "a ", *("".join(r.choice(bits) for _ in range(r.randint(1, 30))) for _ in range(3000)), "word " * 50_000]
    for at in range(0, len(texts), 500):
        part = texts[at : at + 500]
        ids, counts = encoder.encode(pa.array(part, pa.string()))
        ends = np.concatenate(([0], np.cumsum(counts)))
        for i, t in enumerate(part):
            assert ids[ends[i] : ends[i + 1]].tolist() == encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, repr(t)
    assert len(encoder.new) + len(encoder.old) < 1_000


def test_null_and_repeated_ids(spark, tmp_path):
    rows = [(None, "b c"), (1, "x y"), (1, "x y"), (1, None), (0, "a")]
    tokens.write(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "t"))
    got = [tuple(x) for x in tokens.digests(tokens.read(spark, str(tmp_path / "t"))).orderBy("start").select("id", "start", "n_tokens").collect()]
    assert [i for i, *_ in got] == [None, 0, 1, 1, 1]
    assert [s for _, s, _ in got] == np.cumsum([0, *(n for *_, n in got[:-1])]).tolist()
