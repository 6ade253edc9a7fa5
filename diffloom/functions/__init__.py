"""Column functions: plain expressions that stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(fn: Callable[..., Column], *exprs: Column | str) -> Column:
    """``fn`` applied to ``exprs``, each evaluated once per row.

    An expression captured by a lambda is evaluated again for every element, also
    when it came from an earlier ``select`` that the optimizer merged.  Binding it
    to a lambda variable of a one-element array prevents that.  The result is copied,
    so bind what is large and return what is small.
    """
    if not exprs:
        return fn()
    head, *rest = exprs
    return F.element_at(
        F.transform(F.array(as_col(head)), lambda v: let(lambda *vs: fn(v, *vs), *rest)), 1)


def once(c: Column | str) -> Column:
    """An array column for a generator (explode, inline) that leaves it evaluated once.

    Of a plain column the optimizer infers a filter on its size, and pushes it below the
    projection that computes it.
    """
    return F.concat(as_col(c))
