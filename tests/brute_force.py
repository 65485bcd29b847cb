"""Row-by-row models of the correlation types, written from their definitions.

A match is (ts, rule, value, id); lists are ordered by (ts, id).
"""


def window(rows, i, span):
    return [r for r in rows[:i + 1] if rows[i][0] - r[0] <= span]


def holds(live, op, threshold):
    return {"gte": live >= threshold, "gt": live > threshold, "eq": live == threshold}[op]


def bursts(rows, span, fires):
    """(first, trigger, last, n) of every burst; ``fires`` looks at the trailing window."""
    found, members, trigger = [], [], None
    for i, row in enumerate(rows):
        if members and row[0] - members[-1][0] > span:
            found.append((members[0][0], trigger, members[-1][0], len(members)))
            members = []
        if members:
            members.append(row)
        elif fires(window(rows, i, span)):
            members, trigger = window(rows, i, span), row[0]
    if members:
        found.append((members[0][0], trigger, members[-1][0], len(members)))
    return found


def event_count(rows, span, op, threshold):
    return bursts(rows, span, lambda w: holds(len(w), op, threshold))


def value_count(rows, span, op, threshold):
    return bursts(rows, span,
                  lambda w: holds(len({r[2] for r in w if r[2] is not None}), op, threshold))


def temporal(rows, span, rules):
    return bursts(rows, span, lambda w: {r[1] for r in w} >= set(rules))


def ordered(rows, span, rules):
    """(first, last) of every accepted chain."""
    found, end = [], None
    for i, start in enumerate(rows):
        if start[1] != rules[0] or (end is not None and start[0] <= end):
            continue
        at, complete = i, True
        for rule in rules[1:]:
            fit = [j for j, r in enumerate(rows) if r[1] == rule and j != at
                   and r[0] >= rows[at][0] and r[0] - start[0] <= span]
            if not fit:
                complete = False
                break
            at = fit[0]
        if complete:
            end = rows[at][0]
            found.append((start[0], end))
    return found
