"""Small graphs and plain-Python models to compare with."""

SIMPLE = "NODES 5\nEDGES\n0 1\n0 2\n1 3\n2 3\n3 4\n"
WEIGHTED = "NODES 4\nWEIGHTED\nEDGES\n0 1 4\n0 2 1\n2 1 2\n1 3 1\n2 3 5\n"
DISCONNECTED = "NODES 4\nEDGES\n0 1\n2 3\n"
DANGLING = "NODES 4\nEDGES\n0 1\n1 2\n2 0\n1 3\n"
COMPONENTS = "NODES 12\nUNDIRECTED\nEDGES\n0 1\n1 2\n2 0\n2 3\n4 5\n5 6\n6 7\n7 4\n8 9\n8 10\n8 11\n"
COMMUNITIES = "NODES 8\nUNDIRECTED\nEDGES\n0 1\n0 2\n0 3\n3 4\n4 5\n4 6\n4 7\n5 6\n7 5\n"


def model(n, arcs, algorithm, source=None, cap=None):
    """(states, number of steps, logs, cap reached); arcs are (src, dst, weight) in list order."""
    out = {v: [a for a in arcs if a[0] == v] for v in range(n)}
    weight = {(a, b): w for a, b, w in arcs}
    cap = cap if cap is not None else (max(50, n * n) if algorithm == "pagerank" else max(1, n))
    if algorithm == "pagerank":
        state = {v: 1 / n for v in range(n)}
        emit, steps = dict(state), 0
        while steps < cap:
            loose = sum(emit[v] for v in range(n) if not out[v])
            new = {v: 0.15 / n + 0.85 * (loose / n) for v in range(n)}
            for v in range(n):
                for _, b, _ in out[v]:
                    new[b] += 0.85 * emit[v] / len(out[v])
            kept = {v: state[v] if abs(new[v] - state[v]) <= 1e-9 else new[v] for v in range(n)}
            changed, state, emit, steps = kept != state, kept, new, steps + 1
            if not changed:
                return state, steps, [], False
        return state, steps, [], True
    if algorithm in ("bfs", "sssp"):
        state = {v: (0, None) if v == source else (None, None) for v in range(n)}
        box = [(b, source, 0) for _, b, _ in out[source]]
    else:
        state = {v: v for v in range(n)}
        box = [(b, v, v) for v in range(n) for _, b, _ in out[v]]
    steps, logs = 0, []
    while True:
        if steps >= cap:
            return state, steps, logs, True
        inbox = {}
        for b, a, x in box:
            inbox.setdefault(b, []).append((a, x))
        if not inbox:
            return state, steps, logs, False
        new, box = dict(state), []
        for v in sorted(inbox):
            if algorithm in ("bfs", "sssp"):
                d, a = min((x + (1 if algorithm == "bfs" else weight[a, v]), a) for a, x in inbox[v])
                if state[v][0] is None or d < state[v][0]:
                    new[v] = (d, a)
                    box += [(b, v, d) for _, b, _ in out[v]]
                continue
            if algorithm == "cc":
                new[v] = min([state[v]] + [x for _, x in inbox[v]])
            else:
                votes = {state[v]: 1}
                for _, x in inbox[v]:
                    votes[x] = votes.get(x, 0) + 1
                new[v] = min(votes, key=lambda k: (-votes[k], k))
            box += [(b, v, new[v]) for _, b, _ in out[v]]
        changed, state = new != state, new
        logs.append((len(inbox), len(box)))
        steps += 1
        if not changed:
            return state, steps, logs, False
