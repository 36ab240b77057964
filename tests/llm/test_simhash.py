import xxhash

from tokenframe.llm.simhash import _roots, near_duplicates

from .fixtures import documents, empty, rows


def brute(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps):
    root = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(len(fps)):
                if (fps[i] ^ fps[j]).bit_count() <= 2 and root[j] < root[i]:
                    root[i] = root[j]
                    changed = True
    return root


def test_against_brute_force(spark):
    r = rows()
    got = {x.doc_id: x for x in near_duplicates(documents(spark)).collect()}
    assert len(got) == len(r)
    fps = [brute(x[1]) for x in r]
    assert [int(got[i].fingerprint, 16) for i in range(len(r))] == fps
    assert [got[i].component_id for i in range(len(r))] == components(fps)


def test_chain_and_copies(spark):
    import numpy as np

    fps = np.array(sorted({(1 << i) - 1 for i in range(17)} | {7 << 58}), np.uint64)
    _, root = _roots(fps, 2)
    assert set(root[:-1].tolist()) == {0} and root[-1] == len(fps) - 1
    many = np.arange(4096, dtype=np.uint64)
    assert set(_roots(many, 2)[1].tolist()) == {0}


def test_empty_table_and_repeated_rows(spark):
    assert near_duplicates(empty(spark)).count() == 0
    d = documents(spark)
    assert near_duplicates(d.union(d)).count() == 2 * d.count()
