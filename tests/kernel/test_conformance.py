from dataclasses import replace

import pytest

from siltstone.plans import conformance
from siltstone.plans.packages import PACKAGES, github, jenkins
from siltstone.plans.rules import Marker, OutcomeMarker, Package, Role


@pytest.mark.parametrize("package", PACKAGES, ids=lambda p: p.name)
def test_packages_conform(package):
    assert conformance.run(package) == []


def test_faults_are_found():
    assert conformance.ascii_rows(Package("a", roles=(Role("é", "GroupBegin"),)))
    assert conformance.round_trips(Package("a", markers=(Marker("x ", "Step", extract="rest", gate="a", excludes=("alpha",)),)))
    assert conformance.gate_honesty(Package("a", roles=(Role("{n}x", "None", "a", shape=True),)))
    flips = iter(range(10**6))
    assert conformance.determinism(Package("a", echoed_source=lambda line: next(flips) % 2 == 0))


def test_differences():
    assert conformance.differences(github, github) == []
    other = replace(jenkins, version="9", outcome_markers=(OutcomeMarker("End: ", "jenkins"),))
    assert len(conformance.differences(jenkins, other)) == 3


def test_loggers(caplog):
    from siltstone.plans.rules import compose
    from siltstone.session import init_logging, logger

    init_logging("INFO")
    with caplog.at_level("INFO", "siltstone"):
        compose(github)
    assert "1 packages" in caplog.text
    with pytest.raises(ValueError, match="no logger"):
        logger("x")
