"""What learning the segments of a batch holds in a Python worker."""

import random
import tracemalloc

from driftwatch.llm import pieces
from driftwatch.llm.queries import PIECE_MODEL


def test_new_segments_are_learnt_in_bounded_parts(monkeypatch):
    model = pieces.read_model(PIECE_MODEL)
    rng = random.Random(7)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(3, 12))) for _ in range(60_000)]
    texts = [" ".join(words[i : i + 300]) for i in range(0, len(words), 300)] + ["", "  ", "x" * 200_000, "ü€ 𝄞"]
    one_by_one = pieces.Encoder(model)
    few = [one_by_one.encode([t])[0] for t in texts[:3] + texts[-4:]]
    held, learn = [], pieces.Encoder.learn

    def traced(self, segments):
        tracemalloc.start()
        learn(self, segments)
        held.append((max(map(len, segments)), tracemalloc.get_traced_memory()[1]))
        tracemalloc.stop()

    monkeypatch.setattr(pieces.Encoder, "learn", traced)
    found = pieces.Encoder(model).encode(texts[:-2] + texts[-1:])
    assert [*found[:3], *found[-3:]] == few[:3] + few[3:5] + few[6:]
    assert held and max(m for _, m in held) < 32_000_000
    assert pieces.Encoder(model).encode(texts[-2:-1]) == few[5:6]
