import hashlib
from collections import Counter

import corpus_pipeline
import public_tokenizers
import tiktoken

from tallyloom.llm.bpe import read_ranks
from tallyloom.llm.catalog import rank_file
from tallyloom.llm.common import stored
from tests.llm.helpers import WORD, awkward_rows, lower, table_of
from tests.llm.test_dedup import brute_components
from tests.llm.test_shards_and_mix import plain_targets


def test_stages_in_order_against_plain_python(spark, data, tmp_path):
    docs = table_of(spark, tmp_path, awkward_rows(), name="documents")
    spark.read.parquet(f"{data}/pages.parquet").limit(0).write.parquet(f"{tmp_path}/pages.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == list(stages) and len(stages) == 5
    columns, before = docs.columns, docs
    for name, stage in stages.items():
        after = stored(stage(spark, before, str(tmp_path)), "stage")
        rows, given = after.collect(), before.collect()
        if name != "byte-level BPE encoding and decoding":
            assert after.columns == columns and not set(rows) - set(given)
        if name == "language ID":
            assert all((r.text or "").strip() for r in rows)
        if name == "exact dedup":
            texts = Counter(lower(r.text) for r in rows)
            assert set(texts) == {lower(r.text) for r in given} and max(texts.values()) == 1
        if name == "MinHash near-dedup":
            assert len(rows) == brute_components(given, 5, 80)[1] == brute_components(rows, 5, 80)[1]
        if name == "mixing sources to target weights":
            words = lambda r: len(WORD.findall(r.text or ""))
            sizes, taken, longest = Counter(), Counter(), Counter()
            for r in given:
                sizes[r.source] += words(r)
                longest[r.source] = max(longest[r.source], words(r))
            for r in rows:
                taken[r.source] += words(r)
            for source, target in plain_targets(dict(sizes)).items():
                assert abs(taken[source] - target) <= longest[source] / 2 + 1
            assert max(Counter(rows).values()) <= 2 * max(Counter(given).values())
        if name == "byte-level BPE encoding and decoding":
            library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(rank_file()), special_tokens={})
            want = Counter((r.doc_id, tuple(library.encode_ordinary(r.text)), hashlib.sha256(r.text.encode()).hexdigest()) for r in given)
            assert Counter((r.doc_id, tuple(r.ids), r.decoded_sha256) for r in rows) == want
        before = after


def test_run_is_registered_and_covers_the_mixture(spark, data):
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert corpus_pipeline.run(spark, data).count() > 0
