"""Near-duplicate chunks against all pairs."""

import random

import pytest

from creditmill.operators import similar_chunks


def shingle_set(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [None, "", "  ", "one", "One", "two words"]
    for size in (4, 5, 9, 20, 60, 200):
        for _ in range(6):
            words = [r.choice(vocabulary) for _ in range(size)]
            texts.append(" ".join(words))
            for _ in range(5):
                other = list(words)
                for _ in range(r.randint(0, max(1, size // 40))):
                    other[r.randrange(size)] = r.choice(vocabulary)
                texts.append(" ".join(other + r.choices(vocabulary, k=r.randint(0, size // 12))))
    line = " ".join(r.choice(vocabulary) for _ in range(40))
    texts += [f"{line} v{i % 9} v{i % 4}" for i in range(60)]  # one template
    r.shuffle(texts)
    return [(f"c{i:03d}", t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("block", [3, 2048])
def test_links_equal_all_pairs(spark, block):
    rows = corpus(2)
    links, members = similar_chunks.near_duplicates(spark.createDataFrame(rows, "id string, t string"), "id", "t", block=block)
    sets = {i: shingle_set(t) for i, t in rows}
    first = {}
    for i, s in sorted(sets.items()):
        first.setdefault(s, i)
    class_of = {i: first[s] if s else i for i, s in sets.items()}
    assert {r.id: r.class_id for r in members.collect()} == class_of
    heads = sorted(i for i, c in class_of.items() if i == c and sets[i])
    wanted = {}
    for k, a in enumerate(heads):
        for b in heads[k + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared * 185 >= 85 * (len(sets[a]) + len(sets[b])):
                wanted[a, b] = shared
    found = links.collect()
    assert {(r.a, r.b): r.shared for r in found} == wanted and len(found) == len(wanted) > 100
    assert all(r.similarity >= 0.85 for r in found)


def test_unlike_chunks_of_one_phrase_are_no_candidates(spark):
    """A phrase that all chunks share is not in their prefixes."""
    phrase = " ".join(f"p{i}" for i in range(12))
    rows = [(i, phrase + " " + " ".join(f"w{i}x{k}" for k in range(60))) for i in range(200)]
    sets = similar_chunks.shingle_sets(spark.createDataFrame(rows, "id bigint, t string"), "id", "t")
    assert similar_chunks.candidates(sets.select("id", "shingles")).count() == 0


def test_empty_table(spark):
    links, members = similar_chunks.near_duplicates(spark.createDataFrame([], "id string, t string"), "id", "t")
    assert links.count() == 0 and members.count() == 0
