import datetime
import json

import pytest

from lattiq import config as C


def test_defaults_and_no_document():
    c = C.load(None)
    assert c.enabled_rules() == ["ARCH-001"]
    assert C.from_dict({}).enabled_rules() == C.CONFIGURABLE


def test_strict():
    with pytest.raises(C.ConfigError) as e:
        C.from_dict({"nope": 1, "rules": {"ARCH-999": "error"}})
    assert "nope: unknown key" in str(e.value)
    bad = {"rules": {"ARCH-007": {"max_fan_out": 0}, "ARCH-001": {"max_depth": 2}}, "architecture": {"layers": {"a": {"patterns": [], "canImport": ["zz"]}}, "coverage": {"minimum": 101}}, "project": {"roots": ["../x"]}, "resolution": {"mode": "x"}, "suppressions": {"paths": [{"pattern": "a", "rules": ["ARCH-001"], "expires_at": "2024-02-30"}]}}
    with pytest.raises(C.ConfigError) as e:
        C.from_dict(bad)
    lines = str(e.value).splitlines()
    assert lines == sorted(lines)
    for at in ("rules.ARCH-007.max_fan_out", "rules.ARCH-001.max_depth", "architecture.layers.a.canImport", "architecture.coverage.minimum", "project.roots[0]", "resolution.mode", "suppressions.paths[0].reason", "suppressions.paths[0].expires_at"):
        assert any(x.startswith(at + ":") for x in lines), at


def test_extends(tmp_path):
    (tmp_path / "base.json").write_text(json.dumps({"rules": {"ARCH-001": "warning", "ARCH-002": "off"}, "project": {"roots": ["a"]}}))
    (tmp_path / "own.json").write_text(json.dumps({"extends": "base.json", "rules": {"ARCH-002": "info"}}))
    c = C.load(str(tmp_path / "own.json"))
    assert (c.rule("ARCH-001")["severity"], c.rule("ARCH-002")["severity"], c["project"]["roots"]) == ("warning", "info", ["a"])
    (tmp_path / "base.json").write_text(json.dumps({"extends": ["own.json"]}))
    with pytest.raises(C.ConfigError, match="cycle"):
        C.load(str(tmp_path / "own.json"))


def test_overrides_last_match_wins():
    c = C.from_dict({"overrides": [{"files": ["src/**"], "rules": {"ARCH-003": "warning"}}, {"files": ["src/x/**"], "excluded_files": ["src/x/y.ts"], "rules": {"ARCH-003": "off"}}]})
    assert [c.severity("ARCH-003", p) for p in ("a.ts", "src/a.ts", "src/x/a.ts", "src/x/y.ts")] == ["error", "warning", None, "warning"]


def test_expiry_is_inclusive():
    day = datetime.date(2024, 5, 1)
    assert C.expired({"expires_at": "2024-05-01"}, day)
    assert not C.expired({"expires_at": "2024-05-02"}, day)


@pytest.mark.parametrize("name", ["blank", "fsd", "next", "nx"])
def test_presets_are_valid(name):
    C.from_dict(C.preset(name))


DOCUMENT = """\
# ours
version: 1  # first
suppressions:
  require_reason: false # loose
  paths: # by place
    # about a
    - pattern: a/**
      rules: [ARCH-001]
      expires_at: 2020-01-01   # long ago
    # about b
    - pattern: "b/**"
      reason: |
        two
        lines

    - {pattern: c, expires_at: 2020-01-02}
  fingerprints:
    - fingerprint: x
      expires_at: "2020-01-01"
    # tail
rules:
  ARCH-001: off
"""


def test_prune_keeps_all_other_text():
    today = datetime.date(2024, 1, 1)
    text, n = C.pruned_text(DOCUMENT, today)
    assert n == 3
    assert text == """\
# ours
version: 1  # first
suppressions:
  require_reason: false # loose
  paths: # by place
    # about a
    # about b
    - pattern: "b/**"
      reason: |
        two
        lines

  fingerprints: []
    # tail
rules:
  ARCH-001: off
"""
    assert C.pruned_text(text, today) == (text, 0)
    assert C.pruned_text(DOCUMENT.replace("\n", "\r\n"), today)[0] == text.replace("\n", "\r\n")
    with pytest.raises(C.ConfigError, match="block list"):
        C.pruned_text('suppressions:\n  paths: [{pattern: a, expires_at: "2020-01-01"}]\n', today)
    js, n = C.pruned_text('{"suppressions": {"paths": [{"pattern": "a", "expires_at": "2020-01-01"}, {"pattern": "b"}]}}', today)
    assert n == 1 and json.loads(js) == {"suppressions": {"paths": [{"pattern": "b"}]}}
