"""Weftline: data through its schema, as Spark plans.

The public names are loaded when they are first used, so that a Python worker imports only what its function needs.
"""

from importlib import import_module

#: Public names by module.
_NAMES = {
    "functions": ("compile_expr", "evaluate", "failure", "parse", "predicate", "pretty"),
    "operators.edit_lens": ("EditLens",),
    "operators.edits": ("apply_table_edits", "apply_tree_edits"),
    "operators.graph": ("Graph",),
    "operators.lens": ("Complement", "SymmetricLens", "TreeLens"),
    "operators.merge": ("three_way_merge",),
    "operators.query": ("InstanceQuery", "execute"),
    "operators.transforms": ("select",),
    "operators.tree": ("Tree", "restrict", "validate"),
    "plans.compare": ("classify", "compatible", "diff"),
    "plans.lens_text": ("Lens", "LensGraph", "auto_steps", "compile_document"),
    "plans.migration": ("Compiled", "Migration", "MigrationBuilder", "compile_migration"),
    "plans.protolens": ("Chain", "Rewrite", "from_diff"),
    "schema": ("Edge", "HyperEdge", "Protocol", "Schema", "SchemaBuilder"),
    "sources.registry": ("Registry",),
    "streaming.edits": ("EditedTable",),
    "theory": ("Theory",),
    "versioning": ("Repository",),
}
_WHERE = {n: m for m, names in _NAMES.items() for n in names}
__all__ = sorted(_WHERE)


def __getattr__(name: str):
    if name not in _WHERE:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f"{__name__}.{_WHERE[name]}"), name)


def __dir__() -> list[str]:
    return sorted([*globals(), *__all__])
