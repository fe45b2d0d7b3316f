"""The rules: ids, titles, scopes and options."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    id: str
    title: str
    description: str
    category: str
    scope: str
    configurable: bool = True


#: Ids, titles, descriptions and categories as reports carry them (fixed values).
RULES = {
    r.id: r
    for r in (
        Rule("ARCH-001", "Circular dependency", "Detects strongly connected module components.", "dependency-graph", "global"),
        Rule("ARCH-002", "Forbidden dependency", "Enforces configured dependency policies and architecture presets.", "architecture", "edge"),
        Rule("ARCH-003", "Layer boundary", "Enforces configured layer import direction while allowing same-layer imports.", "architecture", "edge"),
        Rule("ARCH-004", "Feature boundary", "Requires cross-feature dependencies to use public entrypoints.", "architecture", "edge"),
        Rule("ARCH-005", "Private import", "Prevents access to private modules from outside their owner.", "architecture", "edge"),
        Rule("ARCH-006", "Dependency depth", "Limits transitive dependency depth from configured architecture entrypoints.", "maintainability", "global"),
        Rule("ARCH-007", "Outgoing coupling", "Limits the number of modules directly imported by one module.", "maintainability", "edge"),
        Rule("ARCH-008", "Incoming coupling", "Limits the number of modules directly depending on one module.", "maintainability", "edge"),
        Rule("ARCH-009", "Orphan module", "Finds source modules unreachable from configured architecture entrypoints.", "maintainability", "global"),
        Rule("ARCH-010", "Unassigned architecture module", "Requires every source module to belong to a configured architecture layer.", "architecture", "edge"),
        Rule("ARCH-011", "Architecture coverage threshold", "Enforces the configured aggregate minimum for architecture layer ownership.", "architecture", "global"),
        Rule("PACKAGE-001", "Package cycle", "Detects circular dependencies between workspace packages.", "package-graph", "global"),
        Rule("PACKAGE-002", "Forbidden package dependency", "Enforces configured package-to-package dependency policies.", "package-graph", "edge"),
        Rule("PACKAGE-003", "Undeclared workspace dependency", "Requires cross-workspace imports to be declared in the importer manifest.", "package-graph", "edge"),
        Rule("PACKAGE-004", "Cross-package relative import", "Prevents relative paths from bypassing workspace package entrypoints.", "package-graph", "edge"),
        Rule("RUNTIME-001", "Browser to server dependency", "Prevents browser modules from reaching server-only modules transitively.", "runtime-graph", "closure"),
        Rule("RUNTIME-002", "Browser to Node dependency", "Prevents browser modules from reaching Node-only modules transitively.", "runtime-graph", "closure"),
        Rule("RUNTIME-003", "Browser-incompatible package", "Prevents browser modules from reaching configured incompatible packages.", "runtime-graph", "closure"),
        Rule("RUNTIME-004", "Edge-incompatible dependency", "Prevents Edge modules from reaching Node-only modules or incompatible packages.", "runtime-graph", "closure"),
        Rule("RUNTIME-005", "Ambiguous universal runtime", "Detects universal modules that transitively require incompatible runtime capabilities.", "runtime-graph", "closure"),
        Rule("RUNTIME-006", "Incompatible runtime cycle", "Detects dependency cycles that join incompatible runtime domains.", "runtime-graph", "global"),
        Rule("PARSE-001", "Parse failure", "Reports malformed or unreadable source files.", "correctness", "global", False),
        Rule("RESOLVE-001", "Unresolved import", "Reports relative or aliased imports that cannot be resolved.", "correctness", "global", False),
        Rule("RESOLVE-002", "Invalid module specifier", "Reports module specifiers that violate the analysis boundary.", "correctness", "global", False),
        Rule("SUPPRESS-001", "Unused suppression", "Reports suppression directives that did not match a diagnostic.", "maintainability", "global", False),
    )
}
CONFIGURABLE = [r for r, x in RULES.items() if x.configurable]
#: Options beside severity and enabled, and the rules that have them.
OPTIONS = {"max_depth": ("ARCH-006",), "max_fan_out": ("ARCH-007",), "max_fan_in": ("ARCH-008",), "entrypoints": ("ARCH-006", "ARCH-009"), "include_type_only": ("ARCH-001",)}
