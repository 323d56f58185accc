"""Line dedup with more than two edits, against brute force."""

import random

from tests.llm import brute
from veilframe.llm import common, lines


def test_five_edits_equal_brute_force(many_partitions):
    spark, rng = many_partitions, random.Random(5)
    common.prepare(spark)
    texts = []
    for size in (24, 45, 70, 85, 110, 150):
        for _ in range(2):
            line = "".join(rng.choice("abcdefgh 0123456789") for _ in range(size))
            texts.append(line)
            for edits in (1, 2, 3, 4, 5, 6, 7):
                other = list(line)
                for _ in range(edits):
                    at = rng.randrange(len(other))
                    other[at : at + 1] = rng.choice(["x", "", other[at] + "y"])
                texts.append("".join(other))
    texts = list(dict.fromkeys(t for t in texts if t.strip()))
    rng.shuffle(texts)
    found = lines.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), max_edits=5)
    near = {r.doc_id for r in found.where("n_near > 0").collect()}

    def alike(a, b):
        k = min(5, int(min(len(a), len(b)) * 0.05))
        return k > 0 and abs(len(a) - len(b)) <= k and brute.edit_distance(a, b) <= k

    late = {j for j in range(len(texts)) for i in range(j) if alike(texts[i], texts[j])}
    assert near == late and len(late) > 30
