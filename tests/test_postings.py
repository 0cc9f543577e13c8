from hypothesis import given
from hypothesis import strategies as st

from tracelode.functions.postings import contains, decode, encode


@given(st.sets(st.integers(0, 1 << 40), max_size=700), st.lists(st.integers(0, 1 << 40), max_size=20))
def test_round_trip(ids, other):
    own = sorted(ids)
    data = encode(own)
    assert decode(data) == own
    probe = own[::7] + other
    assert contains(data, probe) == [x in ids for x in probe]
