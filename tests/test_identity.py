"""Identity codes and strict counts against a loop over all pairs; preflight against small studies."""

import random
from collections import Counter

from tessarix.operators import identity, review

STUDY = "uid string, name string, dob string, date string, modalities array<string>, regions array<string>, n long"
TOLD = "report long, name string, dob string, exam_date string, result_date string, modalities array<string>, regions array<string>, declared array<string>"


def rows(seed):
    r = random.Random(seed)
    name = lambda: r.choice(["", "A B", "C D", "E F"])
    day = lambda: r.choice(["", "20200101", "20200102"])
    some = lambda x: r.choice([[], [x[0]], [x[1]], list(x)])
    studies = [(f"u{i}", name(), day(), day(), some(("CT", "MR")), some(("KNEE", "HEAD")), r.choice([3, 7])) for i in range(40)]
    told = []
    for i in range(60):
        own = name()
        told.append((i, own, day(), day(), day(), some(("CT", "MR")), some(("KNEE", "HEAD")), sorted(set(r.choice([[], [own], [own], [own], [own, "Z Z"]])) - {""})))
    return studies, told


def sets(a, b):
    return "unknown" if not a or not b else "compatible" if set(a) & set(b) else "conflict"


def code(s, t):
    _, name, dob, date, mods, _, _ = s
    _, own, r_dob, exam, _, r_mods, _, declared = t
    if not name or not own:
        return identity.MISSING
    if name != own:
        return identity.DIFFERENT
    if not declared:
        return identity.NO_LINE
    if declared != [name]:
        return identity.DECLARATIONS
    if dob and r_dob and dob != r_dob:
        return identity.DOB
    if not dob or not r_dob:
        return identity.NO_DOB
    if exam and exam != date:
        return identity.EXAM
    return identity.MODALITY if sets(mods, r_mods) == "conflict" else identity.CONSISTENT


def test_codes_equal_all_pairs(spark):
    seen = set()
    for seed in (1, 2):
        studies, told = rows(seed)
        want = Counter()
        for s in studies:
            for t in told:
                want["all", code(s, t)] += 1
                want["chosen", code(s, t)] += s[6] == 7
        ours, theirs = spark.createDataFrame(studies, STUDY), spark.createDataFrame(told, TOLD)
        got = {(r.cohort, r.code): r.pairs for r in identity.codes(ours, theirs, 7).collect()}
        assert got == {k: n for k, n in want.items() if n}
        seen |= {c for _, c in got}
    assert len(seen) == 9
    assert identity.codes(ours.limit(0), theirs, 7).count() == identity.codes(ours, theirs.limit(0), 7).count() == 0


def test_strict_counts_equal_all_pairs(spark):
    studies, told = rows(3)
    want = {}
    for s in studies:
        c = Counter()
        for t in told:
            if not (s[1] and s[2] and s[1] == t[1] and s[2] == t[2]):
                continue
            kind, part = sets(s[4], t[5]), sets(s[5], t[6])
            c["name_dob"] += 1
            c["strict_candidate"] += bool(t[3] and t[3] == s[3] and kind == part == "compatible")
            c["supporting_result_date_only"] += bool(not t[3] and t[4] and t[4] == s[3] and "conflict" not in (kind, part))
            c["modality_conflict"] += kind == "conflict"
            c["region_conflict"] += part == "conflict"
            c["unknown_exam_classification"] += "unknown" in (kind, part)
        want[s[0]] = {k: n for k, n in c.items() if n}
    got = identity.strict_counts(spark.createDataFrame(studies, STUDY), spark.createDataFrame(told, TOLD)).collect()
    assert {r.uid: {k: n for k, n in r.asDict().items() if k != "uid" and n} for r in got} == want
    assert any("strict_candidate" in c for c in want.values())


def test_preflight(spark):
    kinds = "study_uid string, read_study string, series_uid string, sop_uid string, sop_class string, syntax string, frames int, readable boolean, active boolean"
    good = lambda u, sop, syntax="1.2.840.10008.1.2": (u, u, "s", sop, "c", syntax, 1, True, True)
    files = [good("a", "1"), good("a", "2", "1.2.840.10008.1.2.4.50"), good("b", "1"), good("b", "1"), good("c", "1", ""), ("d", "other", "s", "1", "c", "1.2.840.10008.1.2.4.70", 3, True, True), (*good("e", "1")[:7], None, True), (*good("f", "1")[:8], False), (*good("g", "1")[:4], None, "1.2.840.10008.1.2.4.90", 1, True, True)]
    got = {r.uid: r for r in review.preflight(spark.createDataFrame(files, kinds)).collect()}
    assert {u: r.ready for u, r in got.items()} == {"a": True, "b": False, "c": False, "d": False, "e": False, "g": False}
    assert (got["a"].unsupported, got["a"].native, got["b"].sops, got["d"].errors, got["d"].multiframe, got["e"].errors) == (1, 1, 1, 1, 1, 1)
    assert got["c"].missing == {"syntax": 1} and got["g"].missing == {"sop_class": 1} and (got["d"].compressed, got["g"].compressed) == (1, 1)
