"""Plain versions of what the operators find."""


def texts_of(df):
    return {r["doc_id"]: (r["text"] or "").encode() for r in df.select("doc_id", "text").collect()}


def plain_sets(texts):
    out = {}
    for i, t in texts.items():
        w = t.lower().split()
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def plain_components(sets, percent=80):
    label = {i: i for i in sets}
    def top(a):
        while label[a] != a:
            a = label[a]
        return a
    ids = sorted(i for i in sets if sets[i])
    for x in ids:
        for y in ids:
            if x < y and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                a, b = top(x), top(y)
                label[max(a, b)] = min(a, b)
    return {i: top(i) for i in sets}


def plain_spans(texts):
    seen, out = set(), {}
    for d in sorted(texts):
        t, spans, own = texts[d], [], []
        for i in range(len(t) - 49):
            own.append(t[i : i + 50])
            if own[-1] in seen:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + 50
                else:
                    spans.append([i, i + 50])
        seen.update(own)
        out[d] = spans
    return out


def plain_verdicts(rows, max_children=50, z=1.96, min_purity=0.35, prior=2.0, likeness=0.05):
    """Verdicts of (host, path, bad or None) by a tree held in memory."""
    import hashlib
    import re

    paths = [re.sub("[0-9]+", "*", p.removeprefix("/")).split("/") for _, p, _ in rows]
    done = [()] * len(rows)
    for depth in range(max(map(len, paths), default=0)):
        children = {}
        for (h, _, _), d, p in zip(rows, done, paths):
            if len(p) > depth:
                children.setdefault((h, d), set()).add(p[depth])
        done = [d + ("*" if len(children[h, d]) > max_children else p[depth],) if len(p) > depth else d for (h, _, _), d, p in zip(rows, done, paths)]
    count = {}
    for (h, _, bad), d in zip(rows, done):
        for k in range(len(d) + 1):
            c = count.setdefault((h, d[:k]), [0, 0])
            if bad is not None:
                c[not bad] += 1
    own = {}
    for (h, _, bad), d in zip(rows, done):
        c = own.setdefault((h, d), [0, 0])
        if bad is not None:
            c[not bad] += 1
    weigh = lambda x, n: int(x * 1e6 / (1.0 + (n - 1.0) * likeness))
    weight, siblings = {}, {}
    for (h, d), (bad, good) in count.items():
        if bad + good:
            siblings.setdefault((h, d[:-1] if d else None), []).append(((bad + 1.0) / (bad + good + 2.0), hashlib.md5("/".join(d).encode()).hexdigest(), bad, good, (h, d)))
            if d:
                w = weight.setdefault((h, d[:-1]), [0, 0])
                w[0] += weigh(bad + good, bad + good)
                w[1] += weigh(good, bad + good)
    for at, (bad, good) in own.items():
        if bad + good:
            w = weight.setdefault(at, [0, 0])
            w[0] += weigh(bad + good, bad + good)
            w[1] += weigh(good, bad + good)
    pooled = {}
    for group in siblings.values():
        group.sort()
        run, last = [], None
        for item in [*group, None]:
            if run and (item is None or abs(item[2] / (item[2] + item[3]) - last[2] / (last[2] + last[3])) > z * (lambda n, m, p: (p * (1 - p) * (1 / n + 1 / m)) ** 0.5)(item[2] + item[3], last[2] + last[3], (item[2] + last[2] + 1) / (sum(item[2:4]) + sum(last[2:4]) + 2))):
                bad, good = sum(x[2] for x in run), sum(x[3] for x in run)
                n = sum(weight[x[4]][0] for x in run) / 1e6
                share = sum(weight[x[4]][1] for x in run) / 1e6 / n
                bound = (share + z * z / (2 * n) + z * (share * (1 - share) / n + z * z / (4 * n * n)) ** 0.5) / (1 + z * z / n)
                for x in run:
                    pooled[x[4]] = good, bad + good, bound
                run = []
            if item is not None:
                run.append(item)
                last = item
    out = []
    for (h, _, _), d in zip(rows, done):
        known = [pooled[h, d[:k]] for k in range(len(d) + 1) if (h, d[:k]) in pooled]
        around = 0.5
        for (g, n, _), (g2, n2, _) in zip(known, known[1:]):
            around = (g - g2 + prior * around) / (n - n2 + prior)
        bad = bool(known) and (known[-1][0] + prior * around) / (known[-1][1] + prior) < min_purity
        out.append("block" if bad and (sum(own[h, d]) > 0 or known[-1][2] < min_purity) else "allow")
    return out
