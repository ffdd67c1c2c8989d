"""Recall of near-dedup against all pairs, on whole texts and on what line dedup leaves. Not a test: python -m tests.llm.measure_recall /path/to/tables

Truth is exact: every two texts whose words, as multisets by 512 hashed counts, could be near are
aligned. Pairs are told apart by whether they are still near once repeated lines are gone.
"""

import os
import sys

import numpy as np

from jobscope.llm import line_dedup, order_minhash
from jobscope.llm.common import table
from jobscope.session import build_session
from jobscope.store import written

BINS = 512


def near_pairs(texts: dict[int, str]) -> set[tuple[int, int]]:
    """All pairs of ids whose different texts are near."""
    ids = sorted(texts)
    words = [order_minhash.words_of(texts[i]) for i in ids]
    counts = np.zeros((len(ids), BINS), np.int16)
    for row, w in enumerate(words):
        np.add.at(counts[row], w % BINS, 1)
    sizes, found = counts.sum(1, dtype=np.int64), set()
    order = np.argsort(sizes, kind="stable")
    counts, sizes = counts[order], sizes[order]
    for at in range(len(order)):
        end = np.searchsorted(sizes, sizes[at] / order_minhash.LEAST + 1e-9, "right")
        other = np.arange(at + 1, end)
        common = np.minimum(counts[other], counts[at]).sum(1, dtype=np.int64)
        for k in other[common >= order_minhash.LEAST * sizes[other] - 1e-9]:
            a, b = sorted((int(order[at]), int(order[k])))
            if texts[ids[a]] != texts[ids[b]] and order_minhash.relation(words[a], words[b], order_minhash.LEAST) == order_minhash.NEAR:
                found.add((ids[a], ids[b]))
    return found


def main() -> None:
    spark = build_session("recall", f"local[{os.environ.get('CPUS', 8)}]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    docs = table(spark, sys.argv[1], "documents")
    left = written(line_dedup.dedup_lines(docs), "left")
    truth, texts = {}, {}
    for name, rows in (("whole", docs), ("left", left)):
        texts[name] = {r.doc_id: r.text or "" for r in rows.select("doc_id", "text").collect()}
        truth[name] = near_pairs(texts[name])
        own = {r.doc_id: r.class_id for r in order_minhash.classes(rows).collect()}
        caught = {p for p in truth[name] if own[p[0]] == own[p[1]]}
        print(f"{name}: {len(truth[name])} near pairs of different texts, {len(caught)} in one class, recall {len(caught) / max(1, len(truth[name])):.4f}", flush=True)
        if name == "left":
            whole = truth["whole"]
            still = {p for p in whole if p in truth["left"] or texts["left"][p[0]] == texts["left"][p[1]]}
            both = {p for p in whole if own[p[0]] == own[p[1]]}
            print(f"of the {len(whole)} pairs near on whole texts {len(still)} are near still, of which {len(still & both)} are caught ({len(still & both) / max(1, len(still)):.4f}); of the {len(whole - still)} others {len((whole - still) & both)}")
            emptied = sum(1 for p in whole - still if min(len(texts["left"][i].split()) for i in p) < order_minhash.LEAST * max(len(texts["left"][i].split()) for i in p))
            print(f"in {emptied} of these others line dedup has left one text a fifth shorter than the other, or empty")


if __name__ == "__main__":
    main()
