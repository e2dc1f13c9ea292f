"""Small document tables with every awkward case, and plain versions of the definitions."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
SCHEMA = "doc_id bigint, text string"


def words(text):
    return WORD.findall(text or "")


def folded(text):
    return words((text or "").translate(FOLD))


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


def documents(seed=0, n=60):
    """Prose with copies, near copies, a shared passage, empty, null, short and very long texts."""
    rng = random.Random(seed)
    rows, shared = [], prose(rng, 70)
    for i in range(n):
        kind = i % 6
        if kind == 1 and rows:
            text = rows[rng.randrange(len(rows))][1]
        elif kind == 2 and i > 6:
            w = words(rows[0][1])
            w[rng.randrange(len(w))] = f"changed{rng.randrange(3)}"
            text = " ".join(w)
        elif kind == 3:
            text = f"{prose(rng, rng.randrange(30))}\n{shared}\t{prose(rng, rng.randrange(30))}"
        else:
            text = prose(rng, rng.randrange(1, 200))
        rows.append((i * 3, text))
    rows += [(1001, None), (1002, ""), (1003, " \n\t "), (1004, "one"), (1005, "one two"), (1006, "ONE Two"), (1007, "é ß 漢 🙂 é ß 漢 🙂")]
    rows += [(1010, prose(rng, 30_000, 5000)), (1011, "x" * 100_000), (None, shared)]
    return rows


def smallest_reachable(ids, links):
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}
