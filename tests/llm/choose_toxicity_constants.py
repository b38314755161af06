"""Choose SHRINK, LOSS and PASSES of the toxicity classifier by folds of the training rows only.

python tests/llm/choose_toxicity_constants.py [folder of documents.parquet and labels.parquet]

Rows whose crc32(doc_id as text) mod 4 is 2 are held out: they are dropped before anything else. The remainders 0, 1 and 3
are the folds; each is scored by a model of the other two. The choice is the constants of least log loss over all folds."""

import itertools
import sys
import zlib
from pathlib import Path

import numpy as np
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from sparkledger.llm import toxicity  # noqa: E402

FOLDS = (0, 1, 3)
GRID = {"shrink": (0.0, 1.0, 2.0, 3.0, 4.0), "loss": (0.3, 1.0, 3.0, 10.0), "passes": (8,)}


def main(folder: str) -> None:
    labels = pd.read_parquet(f"{folder}/labels.parquet").dropna(subset=["toxic"])
    labels["fold"] = [zlib.crc32(str(k).encode()) % 4 for k in labels.doc_id]
    rows = labels[labels.fold.isin(FOLDS)].merge(pd.read_parquet(f"{folder}/documents.parquet", columns=["doc_id", "text"]), on="doc_id")
    distinct = toxicity.Distinct()
    grams = [distinct(toxicity.grams(t)) for t in rows.text]
    toxic, fold = rows.toxic.to_numpy(np.uint8), rows.fold.to_numpy()
    results = []
    for shrink, loss, passes in itertools.product(*GRID.values()):
        total, hits, false = 0.0, 0, 0
        for f in FOLDS:
            at = np.flatnonzero(fold != f)
            # fit_rows takes SHRINK from its module.
            toxicity.ratios.__defaults__ = (shrink,)
            m = toxicity.fit_rows(np.concatenate([grams[k] for k in at]), np.array([len(grams[k]) for k in at]), toxic[at], loss, passes)
            for k in np.flatnonzero(fold == f):
                z = m.intercept + (float(m.weights[grams[k]].sum(dtype=np.float64)) if m.weights is not None else 0.0)
                s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                total -= np.log(s if toxic[k] else 1 - s)
                hits += bool(toxic[k]) and s >= toxicity.THRESHOLD
                false += not toxic[k] and s >= toxicity.THRESHOLD
        results.append((total / len(toxic), shrink, loss, passes, hits, false))
        print(f"shrink {shrink:g} loss {loss:g} passes {passes}: log loss {total / len(toxic):.5f}, found {hits} of {int(toxic.sum())}, others marked {false} of {int((1 - toxic).sum())}", flush=True)
    best = min(results)
    print(f"chosen: SHRINK {best[1]:g}, LOSS {best[2]:g}, PASSES {best[3]}")


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1")
