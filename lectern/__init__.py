"""A document-corpus engine on Spark: structured HTML as relational tables.

What a user needs is here by name, and imported when it is first asked for, so that workers load only what they run.
"""

from __future__ import annotations

import importlib

#: Names by the module that they come from; a name of None is the module itself.
_HOMES = {
    "lectern.cli": ("run",),
    "lectern.registry": ("Audit", "Registry", "whole"),
    "lectern.session": ("Context", "Document", "Filesystem", "Sandbox", "validate_document"),
    "lectern.sources.files": ("files",),
    "lectern.sources.store": ("NodeStore", "session_store"),
    "lectern.streaming.incremental": ("LiveVerdicts",),
    "lectern.tables": ("Check", "audited", "table_function"),
}
_FOLDERS = {"lectern.functions": ("lexer", "markup", "script", "text"), "lectern.operators": ("commands", "corpus", "graph", "overlay", "prose", "references", "rewrite", "roster", "selectors", "validate")}
_WHERE = {name: (home, name) for home, names in _HOMES.items() for name in names} | {name: (f"{folder}.{name}", None) for folder, names in _FOLDERS.items() for name in names}

__all__ = sorted(_WHERE)


def __getattr__(name: str):
    if name not in _WHERE:
        raise AttributeError(f"module lectern has no attribute {name}")
    home, own = _WHERE[name]
    module = importlib.import_module(home)
    return getattr(module, own) if own else module
