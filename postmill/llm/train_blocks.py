"""Trains the block labeller: ``python -m postmill.llm.train_blocks [SAMPLES]``.

SAMPLES (6,000 unless given) bounds what is fitted: generated texts of known structure in all notations, see
``block_samples``. A tenth more, of other seeds, is held out. The same is fitted without the LSTM, each leaf by
itself, to show what the context adds.
"""

from __future__ import annotations

import random
import sys

import numpy as np

from postmill.llm.block_samples import NOTATIONS, labelled
from postmill.llm.blocks import LABELS, MODEL, Batch, Labeller


def accuracy(model: Labeller, samples: list) -> float:
    said = model.label([leaves for leaves, _ in samples])
    right = sum(a == b for s, (_, labels) in zip(said, samples) for a, b in zip(s, labels))
    return right / max(1, sum(len(labels) for _, labels in samples))


def fitted(samples: list, epochs: int, context: bool = True, seed: int = 1) -> Labeller:
    rng = np.random.default_rng(seed)
    model = Labeller.fresh(context=context)
    m = {k: np.zeros_like(v) for k, v in model.w.items()}
    v = {k: np.zeros_like(a) for k, a in model.w.items()}
    order = sorted(range(len(samples)), key=lambda i: (len(samples[i][0]), rng.random()))
    groups = []
    for at in range(0, len(order), 32):
        part = [samples[i] for i in order[at : at + 32]]
        x = Batch([leaves for leaves, _ in part])
        y = np.zeros(x.mask.shape, np.int64)
        for k, (_, labels) in enumerate(part):
            y[: len(labels), k] = [LABELS.index(a) for a in labels]
        groups.append((x, y))
    step = 0
    for epoch in range(epochs):
        rate = 0.006 if epoch < epochs * 0.6 else 0.0015
        total = 0.0
        for gi in rng.permutation(len(groups)):
            loss, grads = model.gradients(*groups[gi])
            total += loss
            step += 1
            for k, g in grads.items():
                g = np.clip(g, -1, 1)
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                model.w[k] = (model.w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        print(f"epoch {epoch}: loss {total / len(groups):.6f}", flush=True)
    return model


def main(samples: int = 6000, epochs: int = 16) -> None:
    make = lambda n, seed: [labelled(random.Random(f"{seed} {i}"), NOTATIONS[i % len(NOTATIONS)]) for i in range(n)]
    train, held = make(samples, "train"), make(samples // 10, "held out")
    model = fitted(train, epochs)
    alone = fitted(train, epochs, context=False)
    print(f"held-out accuracy {accuracy(model, held):.5f}, without context {accuracy(alone, held):.5f}")
    np.savez_compressed(MODEL, **model.w)


if __name__ == "__main__":
    main(*map(int, sys.argv[1:3]))
