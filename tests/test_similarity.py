"""Most similar templates by bounds against all pairs."""

import random

import pytest
from scorelake.operators import evidence


@pytest.mark.parametrize("seed", [1, 2])
def test_bounds_lose_no_answer_and_save_pairs(spark, seed):
    draw = random.Random(seed)
    words = "how many runs did the batter score in over ten what is top rate for each bowler list all wickets by phase".split()
    text = lambda: " ".join(draw.choice(words) for _ in range(draw.choice([1, 2, 5, 8, 9, 10, 30])))
    templates = [(f"i{k % 3}", k, text()) for k in range(60)] + [("i0", 60, ""), ("i1", 61, None), ("i1", 62, "Same"), ("i1", 63, "same ")]
    records = [(n, f"i{n % 4}", draw.choice([text(), templates[draw.randrange(60)][2].upper() + "  ", templates[draw.randrange(60)][2][:-3] + "x", "", None, "SAME", "é\t日本", "x" * 250])) for n in range(120)] + [(500, None, "how")]
    counted = []
    found = {r["record_id"]: (r["idx"], r["similarity"]) for r in evidence.best_template(spark.createDataFrame(records, "record_id bigint, item_id string, question string"), spark.createDataFrame(templates, "item_id string, idx bigint, question string"), compared=counted).collect()}
    want = {}
    for n, item, question in records:
        scored = [(-evidence.question_similarity(question, q), i) for it, i, q in templates if it == item]
        if scored:
            want[n] = (min(scored)[1], -min(scored)[0])
    assert found == want
    assert len(counted) == len(evidence.LENGTH_RATIOS) and sum(counted) < sum(1 for _, item, _ in records for it, *_ in templates if it == item) / 2
