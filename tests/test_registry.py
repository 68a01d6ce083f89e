"""Capabilities and reason codes."""

import importlib

from sluicebox.operators import decisions
from sluicebox.plans import registry


def test_codes_are_unique_and_known():
    codes = [c for group in registry.REASON_CODES.values() for c in group]
    assert len(codes) == len(set(codes)) == 21
    assert registry.BLOCKING <= set(codes) and set(decisions.RULES) <= set(codes) and set(decisions.HARD_GATES) <= set(codes)
    assert registry.category_of("exact_duplicate") == "duplicates" and registry.category_of("x") is None


def test_modules_exist():
    for c in registry.CAPABILITIES.values():
        for m in c.modules:
            importlib.import_module(f"sluicebox.{m}")


def test_egress():
    allow = frozenset({"p"})
    assert registry.egress_allowed("demo_strict", "p", allow, False) == (True, None)
    assert registry.egress_allowed("demo_strict", "p", allow, True)[1] == "external_api_raw_pii"
    assert not registry.egress_allowed("banking_strict", "p", allow, False)[0] and not registry.egress_allowed("demo_strict", None, allow, False)[0]
