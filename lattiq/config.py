"""Configuration: defaults, inheritance, validation. One YAML or JSON document."""

from __future__ import annotations

import copy
import datetime
import json
import os
import re
from dataclasses import dataclass, field
from typing import Any

from lattiq.functions.globs import match, regex_of
from lattiq.registry import CONFIGURABLE, OPTIONS

SEVERITIES = ("error", "warning", "info")
MODES = ("node10", "node16", "nodenext", "bundler")
FORMATS = ("human", "json", "jsonl", "sarif")
#: Defaults of every section (fixed values).
DEFAULTS: dict[str, Any] = {
    "version": 1,
    "project": {
        "include": ["**/*.ts", "**/*.tsx", "**/*.js", "**/*.jsx", "**/*.mts", "**/*.cts", "**/*.mjs", "**/*.cjs"],
        "exclude": ["**/*.test.*", "**/*.spec.*", "**/__tests__/**", "**/*.d.ts", "**/*.d.mts", "**/*.d.cts", "**/node_modules/**", "**/dist/**", "**/build/**", "**/coverage/**", "**/.next/**"],
        "roots": ["."],
        "follow_symlinks": False,
        "max_file_size_kb": 2048,
    },
    "resolution": {"mode": "nodenext", "custom_conditions": [], "virtual_modules": []},
    "framework": {"auto_detect": True, "enabled": []},
    "runtime": {"browser_incompatible_packages": [], "edge_incompatible_packages": []},
    "architecture": {
        "layers": {},
        "coverage": {"minimum": None, "allow_unassigned": []},
        "features": {"root": "src/features", "roots": [], "public_entrypoints": [f"index.{e}" for e in ("ts", "tsx", "js", "jsx", "mts", "cts", "mjs", "cjs")], "private_segments": ["internal", "private"]},
        "forbidden_dependencies": [],
        "forbidden_package_dependencies": [],
        "presets": {"monorepo_boundaries": False},
    },
    "rules": {},
    "overrides": [],
    "suppressions": {"require_reason": True, "report_unused": True, "paths": [], "fingerprints": []},
    "output": {"format": "human", "fail_on": "error", "max_warnings": None},
    "baseline": {"file": ".lattiq/baseline.json"},
    "cache": {"enabled": False, "directory": ".lattiq/cache"},
}
ALIASES = {"canImport": "can_import", "node": "node10"}
ENTRY_KEYS = {"paths": {"pattern", "rules", "reason", "owner", "ticket", "expires_at"}, "fingerprints": {"fingerprint", "reason", "owner", "ticket", "expires_at"}}


class ConfigError(ValueError):
    """Every problem found, one on a line, sorted by its path in the document."""


@dataclass
class Config:
    data: dict[str, Any]
    configured: bool = True
    problems: list[str] = field(default_factory=list)

    def __getitem__(self, key: str) -> Any:
        return self.data[key]

    @property
    def layers(self) -> dict[str, dict]:
        return self.data["architecture"]["layers"]

    def rule(self, rule: str) -> dict[str, Any]:
        """Severity, enabled and options of a rule; all rules have a default."""
        return {"severity": "error", "enabled": True} | _rule(self.data["rules"].get(rule, {}))

    def severity(self, rule: str, path: str) -> str | None:
        """The severity at a path, None where the rule is off; of overrides the last that matches counts."""
        own = self.rule(rule)
        for o in self.data["overrides"]:
            if rule in o.get("rules", {}) and match(path, o["files"]) and not match(path, o.get("excluded_files", [])):
                own = own | _rule(o["rules"][rule])
        return own["severity"] if own["enabled"] else None

    def enabled_anywhere(self, rule: str) -> bool:
        return self.rule(rule)["enabled"] or any(_rule(o["rules"][rule]).get("enabled", True) for o in self.data["overrides"] if rule in o.get("rules", {}))

    def enabled_rules(self, only: set[str] | None = None) -> list[str]:
        """Rules to run: without any document the one on cycles alone."""
        return [r for r in CONFIGURABLE if (self.configured or r == "ARCH-001") and self.enabled_anywhere(r) and (only is None or r in only)]

    def can_import(self, layer: str, other: str) -> bool:
        return layer == other or other in self.layers.get(layer, {}).get("can_import", [])

    def prune_expired(self, today: datetime.date | None = None) -> Config:
        """Without suppressions that have expired."""
        data = copy.deepcopy(self.data)
        for kind in ENTRY_KEYS:
            data["suppressions"][kind] = [e for e in data["suppressions"][kind] if not expired(e, today)]
        return Config(data, self.configured)


def expired(entry: dict, today: datetime.date | None = None) -> bool:
    """Whether an entry's last day has come (that day counts as expired)."""
    at = entry.get("expires_at")
    return bool(at) and datetime.date.fromisoformat(str(at)) <= (today or datetime.datetime.now(datetime.timezone.utc).date())


def pruned_text(text: str, today: datetime.date | None = None) -> tuple[str, int]:
    """A document's text without its own suppressions that have expired, and how many went.

    Lines of other entries, comments and the order stay as they are: an entry's lines are those of its nodes
    in the YAML tree. JSON has no comments and is written anew. What the text then says is compared with what it should."""
    import yaml

    want = parse(text)
    lists = {k: v for k in ENTRY_KEYS if isinstance(v := (want.get("suppressions") or {}).get(k), list)}
    gone = {k: [i for i, e in enumerate(v) if isinstance(e, dict) and expired(e, today)] for k, v in lists.items()}
    count = sum(map(len, gone.values()))
    if not count:
        return text, 0
    for k, v in lists.items():
        v[:] = [e for i, e in enumerate(v) if i not in gone[k]]
    if text.lstrip().startswith("{"):
        return json.dumps(want, indent=2, ensure_ascii=False) + "\n", count
    child = lambda node, key: next((pair for pair in node.value if pair[0].value == key), (None, None))
    _, section = child(yaml.compose(text), "suppressions")
    lines, cuts = text.splitlines(keepends=True), []

    def last(node: yaml.Node) -> int:
        """The last line of a node's own text; a block's end mark stands where the next token does."""
        if isinstance(node, yaml.ScalarNode):
            return node.end_mark.line - (node.end_mark.column == 0 and node.end_mark.line > node.start_mark.line)
        inner = [x for v in node.value for x in (v if isinstance(v, tuple) else (v,))]
        return max(map(last, inner)) if inner and not node.flow_style else node.end_mark.line

    for k, which in gone.items():
        if not which:
            continue
        key, items = child(section, k)
        if items.flow_style:
            raise ConfigError(f"suppressions.{k}: must be a block list to be pruned")
        cuts += [(items.value[i].start_mark.line, last(items.value[i]) + 1) for i in which]
        if not lists[k]:  # an empty block list is written out
            at = key.start_mark.line
            lines[at] = lines[at].replace(":", ": []", 1)
    for start, end in sorted(cuts, reverse=True):
        del lines[start:end]
    made = "".join(lines)
    if parse(made) != want:
        raise ConfigError("suppressions: the text can't be edited without changing other entries")
    return made, count


def _rule(value: Any) -> dict[str, Any]:
    if isinstance(value, str):
        return {"enabled": False} if value == "off" else {"severity": value, "enabled": True}
    if value is False:  # YAML reads a bare off as a boolean
        return {"enabled": False}
    return dict(value)


def parse(text: str) -> dict[str, Any]:
    """A JSON document, or YAML where a YAML reader is installed."""
    try:
        return json.loads(text) or {}
    except ValueError:
        pass
    try:
        import yaml
    except ImportError as e:
        raise ConfigError("the document is not JSON, and no YAML reader is installed") from e
    try:
        return yaml.safe_load(text) or {}
    except yaml.YAMLError as e:
        raise ConfigError(str(e)) from e


def merge(base: Any, over: Any) -> Any:
    """Maps merge by key, anything else is replaced."""
    if isinstance(base, dict) and isinstance(over, dict):
        return base | {k: merge(base[k], v) if k in base else v for k, v in over.items()}
    return over


def load_document(path: str, seen: tuple[str, ...] = ()) -> dict[str, Any]:
    """A document with those that it extends merged below it; entries of suppressions note where they stand."""
    path = os.path.abspath(path)
    if path in seen:
        raise ConfigError("extends: cycle through " + " -> ".join([*seen, path]))
    try:
        with open(path, encoding="utf-8") as f:
            own = parse(f.read())
    except OSError as e:
        raise ConfigError(f"cannot read {path}: {e.strerror}") from e
    if not isinstance(own, dict):
        raise ConfigError(f"{path}: a document must be a map")
    above = own.pop("extends", [])
    for kind in ENTRY_KEYS:
        for i, e in enumerate((own.get("suppressions") or {}).get(kind) or []):
            if isinstance(e, dict):
                e["_defined_in"] = f"{os.path.basename(path)}:suppressions.{kind}[{i}]"
                e["_inherited"] = bool(seen)
    merged: dict[str, Any] = {}
    for parent in [above] if isinstance(above, str) else above:
        if os.path.isabs(parent):
            raise ConfigError(f"extends: `{parent}` must be relative")
        merged = merge(merged, load_document(os.path.join(os.path.dirname(path), parent), (*seen, path)))
    return merge(merged, own)


def load(path: str | None) -> Config:
    return Config(copy.deepcopy(DEFAULTS), configured=False) if path is None else from_dict(load_document(path))


def from_dict(document: dict[str, Any]) -> Config:
    """A validated configuration over the defaults."""
    document = _renamed(copy.deepcopy(document))
    errors: list[str] = []
    data = copy.deepcopy(DEFAULTS)
    for key, value in document.items():
        if key not in DEFAULTS:
            errors.append(f"{key}: unknown key")
        elif isinstance(DEFAULTS[key], dict) and not isinstance(value, dict):
            errors.append(f"{key}: must be a map")
        else:
            if isinstance(value, dict) and key != "rules":
                errors += [f"{key}.{k}: unknown key" for k in value if k not in DEFAULTS[key]]
                for part in ("coverage", "features", "presets"):
                    if key == "architecture" and isinstance(value.get(part), dict):
                        errors += [f"{key}.{part}.{k}: unknown key" for k in value[part] if k not in DEFAULTS[key][part]]
            data[key] = merge(data[key], value)
    if not errors:
        errors = validate(data)
    if errors:
        raise ConfigError("\n".join(sorted(errors)))
    return Config(data)


def _renamed(x: Any) -> Any:
    if isinstance(x, dict):
        return {ALIASES.get(k, k) if k == "canImport" else k: _renamed(v) for k, v in x.items()}
    return [_renamed(v) for v in x] if isinstance(x, list) else x


def validate(data: dict[str, Any]) -> list[str]:
    """What is wrong with a merged document, as ``path: problem``."""
    bad: list[str] = []
    say = lambda at, what: bad.append(f"{at}: {what}")

    def globs(at: str, values: Any) -> None:
        for i, g in enumerate(values or []):
            try:
                re.compile(regex_of(g))
            except (ValueError, TypeError, re.error) as e:
                say(f"{at}[{i}]", f"invalid glob: {e}")

    def relative(at: str, path: Any) -> None:
        if not isinstance(path, str) or not path or os.path.isabs(path) or ".." in path.replace("\\", "/").split("/"):
            say(at, "must be a relative path inside the project")

    if data["version"] != 1:
        say("version", "must be 1")
    project = data["project"]
    for i, root in enumerate(project["roots"]):
        relative(f"project.roots[{i}]", root)
    globs("project.include", project["include"])
    globs("project.exclude", project["exclude"])
    if not isinstance(project["max_file_size_kb"], int) or project["max_file_size_kb"] <= 0:
        say("project.max_file_size_kb", "must be above 0")
    resolution = data["resolution"]
    resolution["mode"] = ALIASES.get(resolution["mode"], resolution["mode"])
    if resolution["mode"] not in MODES:
        say("resolution.mode", f"must be one of {', '.join(MODES)}")
    for i, c in enumerate(resolution["custom_conditions"]):
        if not str(c).strip():
            say(f"resolution.custom_conditions[{i}]", "must not be blank")
    for i, name in enumerate(data["framework"]["enabled"]):
        if name != "nextjs":
            say(f"framework.enabled[{i}]", f"unknown framework `{name}`")
    arch = data["architecture"]
    for name, layer in arch["layers"].items():
        layer.setdefault("patterns", [])
        layer.setdefault("can_import", [])
        globs(f"architecture.layers.{name}.patterns", layer["patterns"])
        for k in layer.keys() - {"patterns", "can_import"}:
            say(f"architecture.layers.{name}.{k}", "unknown key")
        for other in layer["can_import"]:
            if other not in arch["layers"]:
                say(f"architecture.layers.{name}.canImport", f"unknown layer `{other}`")
    least = arch["coverage"]["minimum"]
    if least is not None and not (isinstance(least, int) and 0 <= least <= 100):
        say("architecture.coverage.minimum", "must be from 0 to 100")
    globs("architecture.coverage.allow_unassigned", arch["coverage"]["allow_unassigned"])
    globs("architecture.features.public_entrypoints", arch["features"]["public_entrypoints"])
    for kind in ("forbidden_dependencies", "forbidden_package_dependencies"):
        for i, p in enumerate(arch[kind]):
            if set(p) != {"from", "to"}:
                say(f"architecture.{kind}[{i}]", "must have from and to")
            else:
                globs(f"architecture.{kind}[{i}]", p.values())
    for name, value in data["rules"].items():
        _check_rule(say, f"rules.{name}", name, value, True)
    for i, o in enumerate(data["overrides"]):
        at = f"overrides[{i}]"
        for k in o.keys() - {"files", "excluded_files", "rules"}:
            say(f"{at}.{k}", "unknown key")
        if not o.get("files"):
            say(f"{at}.files", "must not be empty")
        globs(f"{at}.files", o.get("files"))
        globs(f"{at}.excluded_files", o.get("excluded_files"))
        for name, value in o.get("rules", {}).items():
            _check_rule(say, f"{at}.rules.{name}", name, value, False)
    supp = data["suppressions"]
    for kind, keys in ENTRY_KEYS.items():
        for i, e in enumerate(supp[kind]):
            at = f"suppressions.{kind}[{i}]"
            for k in e.keys() - keys:
                if not k.startswith("_"):
                    say(f"{at}.{k}", "unknown key")
            for k in ("owner", "ticket"):
                if k in e and not str(e[k]).strip():
                    say(f"{at}.{k}", "must not be blank")
            if (supp["require_reason"] or kind == "fingerprints") and not str(e.get("reason", "")).strip():
                say(f"{at}.reason", "is required")
            if e.get("expires_at"):
                try:
                    if datetime.date.fromisoformat(str(e["expires_at"])).year < 1970:
                        raise ValueError
                except ValueError:
                    say(f"{at}.expires_at", "must be a date YYYY-MM-DD from 1970 on")
            if kind == "paths":
                globs(f"{at}.pattern", [e.get("pattern", "")])
                if not e.get("rules"):
                    say(f"{at}.rules", "must name a rule")
                for r in e.get("rules") or []:
                    if r not in CONFIGURABLE:
                        say(f"{at}.rules", f"unknown rule `{r}`")
            elif not str(e.get("fingerprint", "")).strip():
                say(f"{at}.fingerprint", "must not be blank")
    output = data["output"]
    if output["format"] not in FORMATS:
        say("output.format", f"must be one of {', '.join(FORMATS)}")
    if output["fail_on"] not in ("error", "warning"):
        say("output.fail_on", "must be error or warning")
    if output["max_warnings"] is not None and (not isinstance(output["max_warnings"], int) or output["max_warnings"] < 0):
        say("output.max_warnings", "must not be negative")
    relative("baseline.file", data["baseline"]["file"])
    relative("cache.directory", data["cache"]["directory"])
    return bad


def _check_rule(say: Any, at: str, rule: str, value: Any, options: bool) -> None:
    if rule not in CONFIGURABLE:
        return say(at, "unknown rule")
    if isinstance(value, bool) or isinstance(value, str):
        if value not in (*SEVERITIES, "off", False):
            say(at, f"must be off or one of {', '.join(SEVERITIES)}")
        return None
    for key, v in value.items():
        if key == "severity":
            if v not in SEVERITIES:
                say(f"{at}.severity", f"must be one of {', '.join(SEVERITIES)}")
        elif key == "enabled":
            if not isinstance(v, bool):
                say(f"{at}.enabled", "must be true or false")
        elif not options or rule not in OPTIONS.get(key, ()):
            say(f"{at}.{key}", "is not an option of this rule")
        elif key.startswith("max_") and (not isinstance(v, int) or isinstance(v, bool) or v <= 0):
            say(f"{at}.{key}", "must be above 0")
    return None


def preset(name: str, directories: list[str] | None = None) -> dict[str, Any]:
    """A starting document: blank, fsd, next or nx."""
    if name == "blank":
        return {"version": 1}
    if name == "fsd":
        order = ["app", "processes", "pages", "widgets", "features", "entities", "shared"]
        order = [x for x in order if directories is None or x in directories]
        return {"version": 1, "architecture": {"layers": {x: {"patterns": [f"src/{x}/**"], "canImport": order[i + 1 :]} for i, x in enumerate(order)}, "features": {"root": "src/features"}}}
    if name == "next":
        return {"version": 1, "framework": {"enabled": ["nextjs"]}, "resolution": {"mode": "bundler"}, "rules": {f"RUNTIME-00{i}": "error" for i in range(1, 7)}}
    if name == "nx":
        return {"version": 1, "resolution": {"mode": "bundler"}, "architecture": {"presets": {"monorepo_boundaries": True}, "layers": {"apps": {"patterns": ["apps/**"], "canImport": ["libs"]}, "libs": {"patterns": ["libs/**"], "canImport": ["libs"]}}}}
    raise ConfigError(f"unknown preset `{name}`")


def to_yaml(config: Config) -> str:
    """The merged document as JSON text, which is YAML as well."""
    return json.dumps(config.data, indent=2, ensure_ascii=False)
