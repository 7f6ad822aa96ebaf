"""Plain versions shared by the tests."""

from longform.llm.decontam import normal, shingles
from test_mixing import brute


def contained(text, items):
    words = normal(text).split()
    for q in items:
        qw = normal(q).split()
        if qw:
            n = min(5, len(qw))
            want = shingles(qw, n)
            if len(want & shingles(words, n)) >= 0.8 * len(want):
                return True
    return False


def mixed(rows):
    """Ids as often as the mix takes them (sizes of zero are emitted too, by rate)."""
    import hashlib
    plan, _ = brute(rows)
    target = {}
    for (i, _, size, goal, _), (j, _, s) in zip(plan, sorted(rows, key=lambda r: (str(r[0]),))):
        target[s] = goal / size if size else 0.0
    out = []
    for i, _, s in rows:
        draw = int(hashlib.md5(f"mix-1:{i}".encode()).hexdigest()[:13], 16)
        out += [i] * (int(target[s]) + (draw < (target[s] - int(target[s])) * 16 ** 13))
    return sorted(out)
