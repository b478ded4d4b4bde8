"""Token algebra: expected values and properties."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandwork.functions import motif as mo
from strandwork.functions import stats
from strandwork.functions.motif import Motif

token = st.one_of(st.sampled_from("ACGT."), st.sets(st.sampled_from("ACGT"), min_size=2, max_size=3).map(lambda s: f"[{''.join(sorted(s))}]"))
motifs = st.lists(token, min_size=1, max_size=9).flatmap(lambda t: st.integers(0, len(t) - 1).map(lambda i: Motif.read("".join(t), i)))
R = lambda *a: Motif.read(*a)


@given(motifs)
def test_round_trips(m):
    assert Motif.read(m.text, m.position) == m
    assert m.reverse_complement().reverse_complement() == m
    assert m.stripped().stripped() == m.stripped()
    assert Motif.read_iupac(m.iupac(), m.position) == m
    assert m.one_hot().shape == (len(m), 4) and m.one_hot().max() <= 1
    assert not m.contains(m) and not m.specialises(m) and m.distance(m) == 0


@given(motifs, motifs)
def test_relations(a, b):
    assert a.distance(b) == b.distance(a)
    assert a.merge(b, keep_all=True).stripped() == b.merge(a, keep_all=True).stripped()


@pytest.mark.parametrize("a,i,b,j", [("ATCG", 0, "CGAT", 3), ("AT[CG]G", 0, "C[CG]AT", 3), ("ATC.G.", 0, ".C.GAT", 5), ("ATAC.G.", 2, ".C.GTAT", 4)])
def test_reverse_complement(a, i, b, j):
    assert R(a, i).reverse_complement() == R(b, j)


@pytest.mark.parametrize("a,i,b,j", [("....ATCG", 4, "ATCG", 0), ("ATCG....", 0, "ATCG", 0), ("....AT..CG", 4, "AT..CG", 0), (".....", 2, ".....", 2)])
def test_strip(a, i, b, j):
    assert R(a, i).stripped() == R(b, j)


@pytest.mark.parametrize("a,i,b,j,want", [("ATCG", 2, "ATCG", 2, False), ("ATCG", 0, "AT", 0, True), ("A[TCG]CG", 0, "A.C", 0, True), ("ATCG", 2, "CG", 0, True), ("ATCG", 2, "CG", 2, False), ("CG", 1, "ATCG", 2, False)])
def test_specialises(a, i, b, j, want):
    assert R(a, i).specialises(R(b, j)) is want


@pytest.mark.parametrize(
    "a,b,want",
    [("ATCG", "ATCG", False), ("AGCG", "ATCG", False), ("ATCG", "AT", True), ("ACC", "A[CG]C", True), ("ATCG", "AT.G", True), ("AT.G", "ATCG", False), ("AT[ACG]G", "ATCG", False), ("T.....ATCG...C", "ATCG", True), ("ATCG", "T.....ATCG...C", False), ("[AT]..AT..CG[TA]C..C", "[TA]T..CG[AT][GC]", True)],
)
def test_contains(a, b, want):
    assert R(a, 0).contains(R(b, 0)) is want


@pytest.mark.parametrize(
    "a,i,b,j,want",
    [("A[TCG]CG", 0, "A.C", 0, 2), ("ATCG", 0, "AT", 0, 2), ("ATCG", 2, "CG", 0, 2), ("CG", 0, "ATCG", 2, 2), ("C...ATCG", 6, "CG", 0, 3), ("CG", 0, "C...ATCG", 6, 3), ("C..CG...G", 3, "CG", 0, 2), ("CG", 0, "C..CG...[GC]", 3, 2)],
)
def test_distance(a, i, b, j, want):
    assert R(a, i).distance(R(b, j)) == want


@pytest.mark.parametrize("a,i,b,j,want", [("..A..", 2, "..C..", 2, ("[AC]", 0)), (".ATGC.", 1, ".TAAG", 2, ("A[AT]G", 0))])
def test_merge(a, i, b, j, want):
    assert R(a, i).merge(R(b, j)) == R(*want)


@pytest.mark.parametrize("a,i,b,j,want", [("..A..", 2, "..C..", 2, "..[AC].."), ("G.A..", 2, "..C..", 2, "..[AC].."), (".A..", 1, "..C..", 2, "..[AC].."), (".A......", 1, "..C..", 2, "..[AC]......"), ("[CG].GATC", 3, "G.GATG", 3, "[CG].GAT[CG]")])
def test_merge_keeping_all(a, i, b, j, want):
    assert R(a, i).merge(R(b, j), keep_all=True).text == want


@pytest.mark.parametrize("m,want", [("A[TCG]CG", "ABCG"), ("A.C", "ANC"), ("C...ATCG", "CNNNATCG"), ("C..CG...[GC]", "CNNCGNNNS")])
def test_iupac(m, want):
    assert R(m, 0).iupac() == want


def spread(pattern, position):
    return {R("".join(p), position) for p in itertools.product(*[c if len(c) > 1 else [c] for c in pattern])}


def test_merge_all():
    assert mo.merge_all([R("G.GATC", 3)] * 2) == (R("G.GATC", 3), {R("G.GATC", 3)}, set())
    merged, before, new = mo.merge_all([R("G.GATC", 3), R("C.GATG", 3)])
    assert merged == R("[CG].GAT[CG]", 3) and len(before) == 2 and new == {R("C.GATC", 3), R("G.GATG", 3)}
    merged, before, new = mo.merge_all([R("G.GATC", 3), R("..GAT.", 3)])
    assert merged == R("GAT", 1) and not new and before == spread(["ACGT", ".", "G", "A", "T", "ACGT"], 3)
    for first in (R("G.GATC", 3), R(".G.GATC", 4)):
        merged, before, new = mo.merge_all([first, R("C.GAT.", 3), R("A.GATC", 3), R("T.GAT.", 3)])
        assert merged == R("GAT", 1)
        assert new == spread(["AG", ".", "G", "A", "T", "AGT"], 3)
        assert before == spread(["CT", ".", "G", "A", "T", "ACGT"], 3) | spread(["AG", ".", "G", "A", "T", "C"], 3)
    assert mo.merge_all([R("G.GATC", 3), R("GAT.", 1)])[2] == set()
    merged, _, new = mo.merge_all([R("G.GATC", 3), R("C.GATC", 3), R("G.GATG", 3)])
    assert merged == R("[CG].GAT[CG]", 3) and new == {R("C.GATG", 3)}
    assert mo.merge_all([R(".....", 2)] * 2) == (R(".....", 2), {R(".....", 2)}, set())


def test_align():
    assert mo.align([R("G.GATC", 3), R("GAT..", 1), R(".A...", 1)]) == [R("G.GATC.", 3), R("..GAT..", 3), R("...A...", 3)]


def test_parental_pairs():
    a, b, c, d, e = R("ACGT", 0), R("ACG", 0), R("CGT", 1), R("ACGTG", 0), R("TGCA", 1)
    assert set(mo.parental_pairs([a, b, c, d, e])) == {(b, a), (b, d), (c, a), (c, d), (a, d)}
    f, g, h, i, j, k = R("GGCA[AT]", 2), R("GGCAAT", 2), R("GGCAAT", 4), R("AATTT", 0), R("AATTT", 1), R("AATTTT", 0)
    assert set(mo.parental_pairs([f, g, h, i, j, k])) == {(f, g), (f, h), (i, k), (j, k)}
    assert mo.parental_pairs([R("TTAAGGAG", 6), R("TTAA", 3)]) == [(R("TTAA", 3), R("TTAAGGAG", 6))]


def test_isolated_and_odd_text():
    assert R("A...GATC", 5).isolated(2) == 1 and R("GATC", 1).isolated(2) == 0 and R("A", 0).isolated(2) == 0
    with pytest.raises(ValueError):
        R("A[C", 0)
    assert mo.regex_to_iupac_runs("A......C") == "A$N_{6}$C" and len(mo.kmers(2)) == 16


@settings(max_examples=30)
@given(st.integers(2, 9), st.sets(st.tuples(st.integers(0, 8), st.integers(0, 8)), max_size=20))
def test_cliques(n, pairs):
    near = {i: set() for i in range(n)}
    for a, b in pairs:
        if a != b and a < n and b < n:
            near[a].add(b)
            near[b].add(a)
    full = [set(c) for k in range(1, n + 1) for c in itertools.combinations(range(n), k) if all(y in near[x] for x, y in itertools.combinations(c, 2))]
    want = sorted(sorted(c) for c in full if not any(c < d for d in full))
    assert mo.cliques(near) == want


def test_statistics():
    assert stats.digamma(5.0) == pytest.approx(1.5061176684318003, abs=1e-9)
    m = stats.Model().update(50, 100)
    assert m.counts == (50, 100) and m.mean() == pytest.approx(55 / 160) and m.variance() == pytest.approx(55 * 105 / (160**2 * 161))
    assert m.cdf(0.0) == 0 and m.cdf(1.0) == pytest.approx(1) and 0.4 < m.cdf(m.mean()) < 0.6
    assert stats.Model().update(90, 2).score_against(stats.Model().update(100, 200)) > 0.5
    p, q = np.array([[1.0, 0.5], [0, 0.5]]), np.array([[0.5, 0.5], [0.5, 0.5]])
    assert stats.kl_divergence(p, q) == pytest.approx([np.log(2), 0]) and np.isinf(stats.kl_divergence(q, p)[0])
