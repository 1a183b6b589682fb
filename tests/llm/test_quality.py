import re

import pytest
from fixtures import rows, same, table

from cabgrid.llm import quality


def brute(data):
    out = []
    for r in data:
        t = r[1] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines, seen, dup = t.split("\n"), set(), 0
        for x in lines:
            if re.search(r"[^\x20\x09-\x0D]", x):
                dup += x in seen
                seen.add(x)
        tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        many = {x for x in tri if tri.count(x) > 1} if len(tri) < 2000 else {x for x, n in _count(tri).items() if n > 1}
        rep = len({i + o for i, x in enumerate(tri) if x in many for o in range(3)})
        bad = len(w) < 50 or 100 * rep > 50 * len(w)
        out.append((r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, rep, bad))
    return out


def _count(xs):
    import collections

    return collections.Counter(xs)


def test_base_features_on_awkward_rows(spark):
    data = rows() + [(300, "a b c\n#x\na b c\n \n \n#x\n<>|", "", "", 0), (301, "p q r s " * 200, "", "", 0)]
    got = quality.digest(table(spark, data, clashes=True)).collect()
    same([tuple(r)[:7] for r in got], brute(data))
    assert not any(r.kept and r.base_failed for r in got)


def test_hosts_with_failures_lose_their_documents(spark):
    good = " ".join(f"word{i}" for i in range(60))
    data = [(i, good, None, "good", 0) for i in range(50)]
    data += [(100 + i, good if i < 5 else "short", None, "bad", 0) for i in range(50)]
    data += [(200, "short", None, "tiny", 0), (201, good, None, "tiny", 0), (202, good, None, None, 0)]
    got = {r.doc_id: r.kept for r in quality.digest(table(spark, data)).collect()}
    assert all(got[i] for i in range(50)) and not any(got[100 + i] for i in range(50))
    assert got[201] and got[202] and not got[200]  # two documents are no verdict


@pytest.mark.parametrize("hosts", [[(100, 10), (50, 5), (2, 1)], [(10, 10), (10, 0)], [(5, 0)], []])
def test_prior_is_a_weighted_mean_with_positive_weight(hosts):
    docs, fails = sum(n for n, _ in hosts), sum(f for _, f in hosts)
    mean, weight = quality.prior(len(hosts), docs, fails, sum(f * f / n for n, f in hosts))
    assert weight > 0 and mean == (fails / docs if docs else 0.0)


def test_similar_hosts_are_shrunk_more_than_different_ones():
    def weight(hosts):
        return quality.prior(len(hosts), sum(n for n, _ in hosts), sum(f for _, f in hosts), sum(f * f / n for n, f in hosts))[1]

    assert weight([(100, 10)] * 10) > weight([(100, 1)] * 5 + [(100, 60)] * 5)


def test_empty_table(spark):
    assert quality.digest(table(spark, [])).count() == 0
