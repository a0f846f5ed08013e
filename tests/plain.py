"""Row-by-row evaluation of the scoring formulas, with Python's own numbers."""

from fractions import Fraction
from itertools import permutations

from kinlink.plans.precision import Precision


def ones(b):
    return sum(bin(x).count("1") for x in b)


def compare(config, p, name, left, right):
    if config.fields[name].comparator == "binary":
        same = left == right
        return float(same) if p.exact else (1 << p.dice) * same
    both, total = ones(bytes(a & b for a, b in zip(left, right))), ones(left) + ones(right)
    if total == 0:
        return 0
    return 2 * both / total if p.exact else ((both << p.dice + 1) + (total >> 1)) // total


def term(config, p, a, b, left, right):
    if left[a] is None or right[b] is None:
        return 0, 0
    w = p.pair_weight(config, a, b)
    return compare(config, p, a, left[a], right[b]) * w, w


def order(f, w):
    if isinstance(w, float):  # exact mode orders by the rounded quotient
        return (f / w if w else -1.0, w)
    return (Fraction(f, w) if w else Fraction(-1), w)


def pair(config, p, left, right):
    parts = [term(config, p, n, n, left, right) for n in config.single_fields]
    for g in config.groups:
        options = []
        for perm in permutations(g):
            terms = [term(config, p, a, b, left, right) for a, b in zip(g, perm)]
            options.append((sum(t[0] for t in terms), sum(t[1] for t in terms)))
        parts.append(max(options, key=lambda o: order(*o)))
    return sum(x[0] for x in parts), sum(x[1] for x in parts)


def link(config, mode, client, server):
    """[(index, match, tentative, num, den)] for lists of {field: bytes or None}."""
    p, out = Precision.of(mode, config), []
    for left in client:
        scores = [pair(config, p, left, r) for r in server]
        best = max(range(len(server)), key=lambda i: (order(*scores[i]), -i))
        num, den = scores[best]
        out.append((best, p.limit(config.threshold) * den < num, p.limit(config.tentative_threshold) * den < num, num, den if p.exact else den << p.dice))
    return out


def frames(spark, config, client, server):
    names = ", ".join(f"{n} binary" for n in config.names)
    left = spark.createDataFrame([(i, *[r[n] for n in config.names]) for i, r in enumerate(client)], f"record_idx bigint, {names}")
    right = spark.createDataFrame([(i, f"id{i}", *[r[n] for n in config.names]) for i, r in enumerate(server)], f"row_idx bigint, id string, {names}")
    return left, right


def rows(links):
    return [(r["best_index"], r["match"], r["tentative_match"], r["sum_field_weights"], r["sum_weights"]) for r in links.orderBy("record_idx").collect()]
