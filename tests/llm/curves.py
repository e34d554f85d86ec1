"""Area under the ROC curve."""


def auc(rows):
    """rows: (score, 0 or 1); the share of pairs in order, ties half."""
    good, bad = ([s for s, y in rows if y == k] for k in (1, 0))
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
