from veilframe.functions import words as W
from veilframe.functions.folding import folded
from veilframe.operators.names import NameReader

COMMON = "Luisa Marta Giacomo Filippo Tommaso Franco Sergio Patrizia Emanuele Nicoletta Daniel Andrew Susan Peter Stefan Monika Nicolas Hélène Javier Lucía".split()


def test_default_names_know_common_ones():
    reader = NameReader(W.FIRST_NAMES)
    assert [n for n in COMMON if not reader.is_first(n)] == [] and len({folded(n)[0] for n in W.FIRST_NAMES}) >= 499
    stops = W.NOT_LEADING | W.NOT_SURNAMES | W.AFTER_NAMES | W.PARTICLES | W.BEFORE_COMPANIES
    assert not W.FIRST_NAMES & stops
