"""Many smooth objectives minimised together.

The parameters of all models lie behind each other in one vector.  A step asks
for all losses and gradients at once, which is one pass over the data however
many models there are; L-BFGS then moves every model by its own step length.
Where the losses along a direction can be had for many lengths at once, a step
takes three passes at most, however often its lengths are halved.
"""

from __future__ import annotations

from collections.abc import Callable

MEMORY, DECREASE, HALVINGS = 6, 1e-4, 12


def minimise(at: Callable, starts, iterations: int, tolerance: float, snapshots: tuple[int, ...] = (), along: Callable | None = None):
    """(parameters, {iteration: parameters}) from zero: ``at(x, asked)`` gives a loss a model and the gradient, model m has
    the places starts[m] to starts[m + 1]; only those of the ``asked`` models are read.  A model stops when its loss hardly
    falls or its gradient is small; ``snapshots`` are the parameters after that many iterations.  ``along(x, q, lengths,
    asked)``, if given, is the losses at x - length * q, lengths x models; the length taken is the same without it."""
    import numpy as np
    starts = np.asarray(starts)
    sizes, first = np.diff(starts), starts[:-1]
    dot = lambda a, b: np.add.reduceat(a * b, first)  # noqa: E731  a number a model
    wide = lambda v: np.repeat(v, sizes)
    x = np.zeros(starts[-1])
    f, g = at(x, np.ones(len(sizes), bool))
    steps: list[tuple] = []
    open_models, taken = np.ones(len(sizes), bool), {}
    for done in range(1, iterations + 1):
        q, alphas = g.copy(), []
        for s, y, rho in reversed(steps):
            alphas.append(rho * dot(s, q))
            q -= wide(alphas[-1]) * y
        if steps:
            s, y, rho = steps[-1]
            q *= wide(np.where(rho > 0, dot(s, y) / np.maximum(dot(y, y), 1e-300), 1.0))
        else:
            q /= wide(np.maximum(np.sqrt(dot(g, g)), 1.0))
        for (s, y, rho), a in zip(steps, reversed(alphas), strict=True):
            q += wide(a - rho * dot(y, q)) * s
        q = np.where(wide(-dot(g, q) < 0), q, g)  # a model whose direction does not descend takes the gradient's
        slope, length = -dot(g, q), open_models.astype(float)

        def tried(length, asked):
            f_there, g_there = at(x - wide(length) * q, asked)  # noqa: B023  used within the step
            return np.where(asked, f_there, f), np.where(wide(asked), g_there, g)  # noqa: B023
        f_new, g_new = tried(length, open_models)
        bad = f_new > f + DECREASE * length * slope + 1e-12
        if along and bad.any():
            halves = 0.5 ** np.arange(1, HALVINGS)
            high = along(x, q, halves, bad) > f + DECREASE * halves[:, None] * slope + 1e-12
            length, fits = np.where(bad, halves[np.argmin(high, axis=0)], length), bad & ~high.all(0)
            if fits.any():
                f_fit, g_fit = tried(length, fits)
                f_new, g_new = np.where(fits, f_fit, f_new), np.where(wide(fits), g_fit, g_new)
            bad &= ~fits
        for _ in range(0 if along else HALVINGS - 1):
            if not bad.any():
                break
            length = np.where(bad, length / 2, length)
            f_new, g_new = tried(length, open_models)
            bad = f_new > f + DECREASE * length * slope + 1e-12
        length = np.where(bad, 0.0, length)
        moved = wide(length > 0)
        new, g_new, f_new = np.where(moved, x - wide(length) * q, x), np.where(moved, g_new, g), np.where(length > 0, f_new, f)
        s, y = new - x, g_new - g
        curve = dot(s, y)
        steps = [*steps, (s, y, np.where(curve > 1e-12, 1 / np.maximum(curve, 1e-300), 0.0))][-MEMORY:]
        open_models = (f - f_new > tolerance * 1e-2 * np.maximum(f, 1e-9)) & (np.sqrt(dot(g_new, g_new)) > tolerance)
        x, f, g = new, f_new, g_new
        if done in snapshots:
            taken[done] = x
        if not open_models.any():
            break
    return x, {n: taken.get(n, x) for n in snapshots}
