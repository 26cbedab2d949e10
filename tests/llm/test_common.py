import pytest

from obsgauge.llm import common, near_copies
from obsgauge.llm.common import OUT_BYTES, map_rows


@pytest.mark.parametrize("each", [0, 1, 3])
def test_batches_of_no_one_and_many_rows_beyond_the_byte_limit(spark, docs_of, each):
    texts = [(k, chr(97 + k) * (OUT_BYTES // 3)) for k in range(7)]

    def start():
        return lambda key, text: [(key, part) for part in range(each)]

    out = map_rows(docs_of(texts, 1).select("doc_id", "text"), "doc_id bigint, part int", start, many=True)
    assert sorted(map(tuple, out.collect())) == [(k, p) for k in range(7) for p in range(each)]


def test_unlike_long_texts_are_compared_without_output(spark, docs_of):
    long = [(k, " ".join(f"{k}w{n}" for n in range(common.OUT_BYTES // 16))) for k in (1, 2)]
    assert near_copies.one_of_each(docs_of(long, 1)).count() == 2
