from hypothesis import given, settings
from hypothesis import strategies as st

from quillsieve.llm.automaton import SuffixAutomaton

texts = st.lists(st.lists(st.integers(0, 3), max_size=15), min_size=1, max_size=4)


@settings(max_examples=150, deadline=None)
@given(texts, st.lists(st.integers(0, 4), max_size=15))
def test_matching_statistics(sequences, query):
    sam = SuffixAutomaton(keep_owners=True)
    base = 0
    ends = {}
    for owner, s in enumerate(sequences):
        sam.add(s, range(base, base + len(s)), owner)
        for a in range(len(s)):
            for b in range(a + 1, len(s) + 1):
                ends.setdefault(tuple(s[a:b]), []).append((base + b - 1, owner, b - 1))
        base += len(s)
    sam.finish()
    for k, (state, size) in enumerate(sam.matches(query)):
        expected = max((n for n in range(1, k + 2) if tuple(query[k + 1 - n : k + 1]) in ends), default=0)
        assert size == expected
        for n in range(1, size + 1):
            found = ends[tuple(query[k + 1 - n : k + 1])]
            s = sam.at_least(state, n)
            assert sam.first[s] == min(e for e, _, _ in found)
            assert sam.owners[s] == {o: min(x for _, p, x in found if p == o) for o in {o for _, o, _ in found}}
