import os

import pytest

from lexiloom.plans.oracles import ORACLES

from .support import connection

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["minhash_search", "minhash_similar", "simhash_hamming_pairs", "simhash_block_search", "simhash_block_pairs", "sketch_over_threshold", "recall_precision", "word_jaccard"])
def test_searches_have_answers(name):
    """Nothing compared with nothing would say nothing."""
    assert connection(SF).execute(f"SELECT count(*) FROM ({ORACLES[name]})").fetchone()[0] > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_all_similar_signatures_are_counted():
    found = connection(SF)
    assert found.execute(f"SELECT sum(pairs) FROM ({ORACLES['simhash_block_pairs']})").fetchone()[0] == 11
    assert found.execute(f"SELECT sum(links) FROM ({ORACLES['simhash_block_members']})").fetchone()[0] == 22
