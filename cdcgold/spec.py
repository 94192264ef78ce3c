"""Declarative description of a document: one root table and the child tables folded into it."""

from __future__ import annotations

from dataclasses import dataclass, replace


def _as_tuple(value) -> tuple[str, ...]:
    return (value,) if isinstance(value, str) else tuple(value)


@dataclass(frozen=True)
class ChildSpec:
    """A child table and the array field it becomes.

    ``fields`` lists what is embedded, as names or ``(column, name)`` pairs; None embeds
    every column.  ``other_fk`` is the second end of an edge table.  ``dedupe`` is the
    coarser key the relational baseline reader keeps one row of.
    """

    table: str
    pk: tuple[str, ...]
    fk: str
    array: str
    fields: tuple | None = None
    other_fk: str | None = None
    dedupe: str | None = None

    def __post_init__(self):
        object.__setattr__(self, "pk", _as_tuple(self.pk))

    def pairs(self, columns: list[str]) -> list[tuple[str, str]]:
        """(source column, embedded name) pairs for a table with these columns."""
        if self.fields is None:
            return [(c, c) for c in columns]
        return [(f, f) if isinstance(f, str) else tuple(f) for f in self.fields]


@dataclass(frozen=True)
class ProfileSpec:
    """Root, children and the policies on which folds may differ.

    root_delete  keep: the document survives with its last image; mark: it survives with
                 ``status_field`` set to DELETED; drop: it goes away.
    reparent     keep_both: child state is per (parent, child), so a moved child stays with
                 its old parent too; move: the newest row of a child decides its one parent.
    direction    from: an edge belongs to its first end; both: to either end.
    slices       rows per document.  1: one row per key.  More, for parents with very many
                 children: always that many rows, numbered by ``segment``, over which a digest
                 of the child key deals the children; the key of a row is then (key, segment).
    """

    root: str
    key: str
    children: tuple[ChildSpec, ...] = ()
    fields: tuple | None = None
    root_delete: str = "keep"
    reparent: str = "keep_both"
    direction: str = "from"
    status_field: str = "status"
    slices: int = 1

    def __post_init__(self):
        object.__setattr__(self, "children", tuple(self.children))
        for name, allowed in (
            ("root_delete", ("keep", "mark", "drop")),
            ("reparent", ("keep_both", "move")),
            ("direction", ("from", "both")),
        ):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {allowed}")
        if self.slices < 1:
            raise ValueError("slices must be 1 or more")

    def child(self, array: str) -> ChildSpec:
        return next(c for c in self.children if c.array == array)

    def with_(self, **changes) -> ProfileSpec:
        return replace(self, **changes)
