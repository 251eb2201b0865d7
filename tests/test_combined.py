"""Exchanges of one codon put together, against counting one by one, and what the plan moves for it."""

import random
import re
from itertools import groupby, product

from clademark.functions import sequence as S
from clademark.operators import combined
from clademark.plans import registry

ANN = "run_id int, feature_id int, codon_pos int, codon_offset int, ref_codon string, alt_codon string, coding_alt string, ref_aa string, alt_aa string, consequence string, af double"


def shown(ref, calls):
    """What exchanges ``(offset, base): af`` of a codon show, by the exchange."""
    own = {k: (ref[: k[0]] + k[1] + ref[k[0] + 1 :], round(af, 6), "observed", ()) for k, af in calls.items()}
    offsets = sorted({o for o, _ in calls})
    options = [[(o, b, calls[o, b]) for b in "ACGT" if (o, b) in calls] + [(o, ref[o], max(0, 1 - sum(af for k, af in calls.items() if k[0] == o)))] for o in offsets]
    states = []
    for no, way in enumerate(product(*options)):
        codon = list(ref)
        for o, b, _ in way:
            codon[o] = b
        upper = min(af for _, _, af in way)
        lower = min(max(0, sum(af for _, _, af in way) - len(way) + 1), upper)
        forced = lower / upper if upper else 0
        states.append(("".join(codon), sum(b != ref[o] for o, b, _ in way), lower, forced, lower > 1e-9 and forced >= 2 / 3 - 1e-9, no))
    states = [s for s in states if s[1]]
    if len(offsets) < 2 or not any(s[4] for s in states):
        return own
    for o, b in calls:
        mine = [s for s in states if s[0][o] == b]
        alone = next((s[2] for s in mine if s[1] == 1), 0)
        sure = max((s for s in mine if s[4] and abs(s[3] - 1) <= 1e-9), key=lambda s: (s[1], round(s[2], 9), -s[5]), default=None)
        up = sure if alone <= 1e-9 else None
        sums = {}
        for s in mine:
            if s[4] and s is not up:
                sums[S.CODONS[s[0]]] = sums.get(S.CODONS[s[0]], 0) + s[2]
        own[o, b] = (up[0] if up else own[o, b][0], round(up[2] if up else alone, 6), "estimated", tuple((a, round(v, 6)) for a, v in sums.items()))
    return own


def test_many_exchanges_of_a_codon_equal_counting_one_by_one(spark):
    r = random.Random(4)
    rows = []
    for key in product((1, 2, 3, 4), (1, 2), range(25)):
        ref = r.choice(sorted(S.CODONS))
        for _ in range(r.randrange(1, 7)):  # some calls of an exchange twice
            o = r.randrange(3)
            base = r.choice([b for b in "ACGT" if b != ref[o]])
            alt = ref[:o] + base + ref[o + 1 :]
            rows.append((*key, o, ref, alt, base, S.CODONS[ref], S.CODONS[alt], "missense", r.choice([0.1, 0.25, 0.5, 0.75, 1.0])))
    want = {}
    for key, group in groupby(sorted(rows), lambda x: (*x[:3], x[4])):
        calls = {}
        for x in group:
            calls[x[3], x[6]] = max(x[-1], calls.get((x[3], x[6]), 0))
        want |= {(*key[:3], *k): v for k, v in shown(key[3], calls).items()}
    assert len({v[2] for v in want.values()}) == 2 and any(v[3] for v in want.values())
    # A codon without its run is in none: its exchanges are not combined.
    lost = [(None, 1, 1, o, "AAA", "", "T", "K", "", "missense", 1.0) for o in (0, 1)]
    got = combined.combined_annotations(spark.createDataFrame(rows + lost, ANN)).collect()
    assert [x.freq_method for x in got if x.run_id is None] == ["observed"] * 2
    found = {(x.run_id, x.feature_id, x.codon_pos, x.codon_offset, x.coding_alt): (x.alt_codon, round(x.effect_freq, 6), x.freq_method, tuple((s.aa, round(s.lower, 6)) for s in x.states)) for x in got if x.run_id}
    assert found == want and len(got) == len(want) + 2


def test_exchanges_are_made_and_moved_once(spark):
    for name in ("a4b_combined_annotations", "w6_match_effects"):
        plans = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution()
        assert len(re.findall(r"Relation \[l_orderkey", plans.optimizedPlan().toString())) == 1, name
    moved = registry.QUERIES["a4b_combined_annotations"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\([^)]*codon_pos", moved)) == 1
