"""Random texts and codes against plain versions."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from docketlens.llm import chat, chat_template, packing, quality, simhash

from .test_other_operators import plain_measures
from .test_packing import plain_cost
from .test_simhash import plain_components, plain_fingerprint

TEXT = st.text(alphabet=st.sampled_from(list("ab c\n\t\x0b&<>|#1.é漢\r\x85 ")), max_size=120)


@given(TEXT)
@settings(max_examples=300, deadline=None)
def test_measures(text):
    found = quality.Text(text)
    assert tuple(getattr(found, m) for m in quality.MEASURES) == plain_measures(text)


@given(TEXT)
@settings(max_examples=200, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_escapes(text):
    assert chat_template.unescape(chat_template.escape(text)) == text
    line = chat_template.escape_line(text)
    assert "\n" not in line and chat_template.unescape_line(line) == text


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "x\n<"]), TEXT), max_size=6))
@settings(max_examples=200, deadline=None)
def test_rendered_turns_parse_back(turns):
    render = chat_template.compile_template(chat.CHAT)
    out = "".join(t for t, _ in render({"messages": [{"role": r, "text": t} for r, t in turns]}))
    assert chat.parse_turns(out) == turns


@given(st.lists(st.integers(1, 9), min_size=1, max_size=30), st.data())
@settings(max_examples=200, deadline=None)
def test_cuts(steps, data):
    positions = np.concatenate(([0], np.cumsum(steps)))
    penalty = data.draw(st.lists(st.integers(0, 12), min_size=len(positions), max_size=len(positions)))
    cuts = [0, *packing.best_cuts(positions, np.array(penalty), 16).tolist()]
    weight = dict(zip(positions.tolist(), penalty))
    cost = sum(packing.padding(b - a, 16) + weight[b] for a, b in zip(cuts, cuts[1:]))
    assert cost == plain_cost(positions.tolist(), penalty, 16)


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=12),
       st.lists(st.tuples(st.integers(0, 11), st.sets(st.integers(0, 63), max_size=5)), max_size=60))
@settings(max_examples=150, deadline=None)
def test_index_forest(centres, near):
    codes = list(centres) + [centres[i % len(centres)] ^ sum(1 << b for b in bits) for i, bits in near]
    codes = np.array(sorted(set(codes)), dtype=np.uint64)
    rank = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    codes = codes[np.argsort(rank)]
    labels = simhash.forest(codes, np.zeros(len(codes), dtype=np.int64))
    assert (labels == plain_components(codes, np.arange(len(codes)))).all()
