import json

import pytest
from hypothesis import given
from hypothesis import strategies as st
from kinlink.plans.config import FieldSpec, LinkageConfig, RemoteParty
from kinlink.plans.precision import Precision, ceil_log2, ceil_log2_min1, half_away, hw_size
from kinlink.sources.synth import bench_config, person_config

INT = FieldSpec("i", 0.1, 0.01, "binary", "integer", 12)


def of(*fields, groups=()):
    return LinkageConfig.of(fields, 0.9, 0.7, groups)


def test_person_weights_in_all_precisions():
    c = person_config()
    p16, p32, p64 = (Precision.of(f"int{b}", c) for b in (16, 32, 64))
    assert [(p.dice, p.weight) for p in (p16, p32, p64)] == [(4, 3), (8, 9), (20, 19)]
    want = {
        "geburtsjahr": (5.122059, 2, 173, 177142), "geburtsmonat": (3.582651, 2, 121, 123903), "geburtsname": (15.159760, 7, 511, 524287),
        "geburtstag": (4.901102, 2, 165, 169500), "nachname": (15.159760, 7, 511, 524287), "ort": (6.584963, 3, 222, 227735),
        "plz": (6.584963, 3, 222, 227735), "vorname": (12.040552, 6, 406, 416412),
    }
    assert list(c.fields) == sorted(want)
    for n, (w, *scaled) in want.items():
        assert c.fields[n].weight == pytest.approx(w, abs=1e-6)
        assert [p.pair_weight(c, n, n) for p in (p16, p32, p64)] == scaled


def test_cross_weights_are_averages():
    c = person_config()
    exact = Precision.of("exact", c)
    mean = (c.fields["vorname"].weight + c.fields["nachname"].weight) / 2
    assert exact.pair_weight(c, "vorname", "nachname") == mean
    p = Precision.of("int32", c)
    assert p.pair_weight(c, "nachname", "vorname") == half_away(mean / c.max_weight * 511)


def test_precisions_of_one_and_two_fields():
    assert (Precision.ideal(32, 1).dice, Precision.ideal(32, 1).weight) == (10, 11)
    assert (Precision.ideal(32, 2).dice, Precision.ideal(32, 2).weight) == (10, 10)
    assert Precision.of("int32", of(INT), 5, 6).weight == 6


@given(st.sampled_from([16, 32, 64]), st.integers(1, 60))
def test_ideal_precision_fits(bits, n):
    try:
        p = Precision.ideal(bits, n)
    except ValueError:
        assert bits - ceil_log2(n * n) < 3
        return
    assert p.dice + 2 * p.weight + ceil_log2(n * n) <= bits


def test_rounding_and_logs():
    assert [half_away(x) for x in (0.5, 1.5, 2.4, -0.5, -1.5)] == [1, 2, 2, -1, -2]
    assert [ceil_log2(x) for x in (1, 2, 3, 4, 5, 1024, 1025)] == [0, 1, 2, 2, 3, 10, 11]
    assert ceil_log2_min1(1) == 1 and hw_size(7) == 3 and hw_size(8) == 4


@pytest.mark.parametrize("make", [
    lambda: of(INT, groups=[["i", "x"]]), lambda: of(INT, groups=[["x"]]), lambda: of(INT, groups=[[]]), lambda: of(INT, groups=[["i"], ["i"]]),
    lambda: of(INT, FieldSpec("d", 0.1, 0.01, "dice", "bitmask", 12), groups=[["i", "d"]]), lambda: of(INT, FieldSpec("j", 0.1, 0.01, "binary", "integer", 13), groups=[["i", "j"]]),
    lambda: of(INT, INT), lambda: of(), lambda: FieldSpec("i", 0.1, 0.01, "nGram", "bitmask", 5), lambda: FieldSpec("i", 0.1, 0.01, "dice", "text", 5),
    lambda: FieldSpec("i", 0.5, 0.6, "dice", "bitmask", 5), lambda: FieldSpec("i", 0, 0.1, "dice", "bitmask", 5), lambda: FieldSpec("i", 0.1, 0.1, "dice", "bitmask", 0),
    lambda: FieldSpec("i", 0.1, 0.1, "binary", "integer", 40), lambda: Precision.of("int8", bench_config(20, "integer")), lambda: Precision.of("int24", of(INT)),
    lambda: Precision.of("int32", of(INT), 20, 10), lambda: Precision.of("int32", of(INT), 5), lambda: LinkageConfig.from_json({"algorithm": {}}), lambda: RemoteParty.from_json("r", {}),
])
def test_rejected(make):
    with pytest.raises(ValueError):
        make()


def test_string_bits_warn():
    with pytest.warns(UserWarning):
        FieldSpec("s", 0.1, 0.01, "binary", "string", 13)


def test_json_round_trip_and_compatibility():
    c = person_config()
    again = LinkageConfig.from_json(json.dumps(c.to_json()))
    assert again.to_json() == c.to_json() and c.compatible(again)
    assert not c.compatible(person_config(0.8))
    r = RemoteParty.from_json("a", {"connectionProfile": {"url": "u"}, "matchingAllowed": True, "linkageService": {"url": "s"}})
    assert (r.url, r.linkage_service, r.matching_allowed) == ("u", "s", True)
