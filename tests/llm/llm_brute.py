"""Plain versions that the tests compare with."""


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for s in "\t\n\x0b\x0c\r":
        low = low.replace(s, " ")
    return [w for w in low.split(" ") if w]


def shingles(text, n):
    w = words(text)
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute_components(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(rows[a][0]), find(rows[b][0])))
                root[q] = p
    return {i: (len(s), find(i)) for (i, _), s in zip(rows, sets, strict=True)}


def edits(a, b):
    """Least edits from a to any stretch of b."""
    row = [0] * (len(b) + 1)
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)
