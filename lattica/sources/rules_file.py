"""Rules from a YAML list; the first rule that isn't valid fails the whole file."""

from __future__ import annotations

from lattica.operators.rules import Rule, validate

#: Severities and actions.
SEVERITIES, ACTIONS = ("Info", "Warning", "Error"), ("Report", "Highlight")


def load_rules(path: str) -> list[Rule]:
    import yaml

    with open(path, encoding="utf-8") as f:
        documents = yaml.safe_load(f)
    if not isinstance(documents, list):
        raise ValueError(f"{path}: a list of rules is expected")
    rules = []
    for d in documents:
        try:
            pattern = d["pattern"]
            rule = Rule(d["name"], d["description"], pattern["name_regex"], pattern.get("symbol_kind"), pattern.get("file_pattern"), pattern.get("has_attribute"), d["severity"], d.get("action", "Report"))
        except (KeyError, TypeError) as e:
            raise ValueError(f"{path}: a rule lacks {e}") from None
        if rule.severity not in SEVERITIES or rule.action not in ACTIONS:
            raise ValueError(f"{path}: {rule.name}: unknown severity or action")
        validate(rule)
        rules.append(rule)
    return rules
