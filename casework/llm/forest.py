"""A forest over the rows of one task: what links found in a block join."""

import numpy as np


class Forest:
    """Labels of rows 0..n-1; linked rows share the label of their smallest row."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join rows ``a[i]`` and ``b[i]``."""
        label = self.label
        while True:
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = label[label]
                if np.array_equal(up, label):
                    break
                label[:] = up
        self.label = label

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """One edge for each row that is not the smallest of its tree: fewer edges than rows."""
        child = np.flatnonzero(self.label != np.arange(len(self.label)))
        return child, self.label[child]
