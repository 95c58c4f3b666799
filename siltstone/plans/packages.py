"""The vocabularies that come with the library. Rows are fixed values, in an order that counts for level lifts."""

from __future__ import annotations

import re

from ..functions import times
from ..functions.formats import Format, Parsed
from ..functions.levels import infer_level
from .rules import Declared, Fields, Instance, Lift, Location, Marker, OutcomeMarker, OutcomeToken, Package, Role, Rules, Stop, compose

_ECHO = re.compile(r"\x1b\[(?:36;1|1;36)m[^\x1b]*\x1b\[(?:0|39)?m[ \t\r\n]*\Z")


def _outcomes(gate: str, said: dict[str, str]) -> tuple[OutcomeToken, ...]:
    return tuple(OutcomeToken(token, outcome.upper(), gate) for outcome, tokens in said.items() for token in tokens.split())


def _paired(names: dict[str, str], wrap) -> tuple[tuple[str, str], ...]:
    return tuple((form.format(name), value) for name, value in names.items() for form in wrap)


_COMMANDS = ("##[{}]", "::{}::")
github = Package(
    "github",
    "1.12.0",
    roles=(
        *(Role(p, r) for p, r in _paired({"group": "GroupBegin", "endgroup": "GroupEnd", "error": "Terminator"}, _COMMANDS)),
        Role("Received {n} of {n} ({n}%), {n} MBs/sec", "Progress", "github", shape=True),
        Role("Sent {n} of {n} ({n}%), {n} MBs/sec", "Progress", "github", shape=True),
    ),
    markers=(
        Marker("Current runner version: ", "Job", "Opens", gate="github"),
        Marker("Complete job name: ", "Job", extract="rest", order="Unordered", gate="github"),
        Marker("Run ", "Step", extract="rest", gate="github", channel="stripped", introducer="@"),
        Marker("##[group]Run ", "Step", extract="rest", gate="github", channel="annotated", introducer="@"),
        Marker("Prepare all required actions", "Step", "Opens", gate="github", channel="annotated"),
        Marker(
            "##[start-action ",
            "InnerStep",
            extract="keyed",
            gate="github",
            channel="annotated",
            fields=Fields("id", "display", ".", "_", "__run"),
            since="v2",
        ),
        Marker("##[end-action ", "InnerStep", "Ends", "keyed", gate="github", channel="annotated", fields=Fields(outcome="outcome", propagated="conclusion"), since="v2"),
        Marker("Post job cleanup.", "Step", "Closes", gate="github"),
        Marker("Cleaning up orphan processes", "Step", "Closes", gate="github"),
    ),
    lifts=tuple(Lift(p, level, "github") for p, level in _paired({"error": "Error", "warning": "Warn", "debug": "Debug", "notice": "Info"}, _COMMANDS)),
    outcome_tokens=_outcomes(
        "github",
        {"Success": "success", "Failure": "failure", "Cancelled": "cancelled", "Aborted": "timed_out", "Unknown": "skipped neutral action_required"},
    ),
    declared=(
        Declared("pull_request", ("PR-", "pr-", "Pr-", "pull-", "PULL-", "Pull-", "PR#", "pulls/"), gate="github"),
        Declared("run_id", min_digits=10, gate="github"),
        Declared("pull_request", ("pull/",), min_digits=5, extends=True),
        Declared("head_ref", text=True, prefixes=("refs/heads/", "refs/remotes/origin/", "origin/"), gate="github"),
    ),
    stops=(
        Stop("##[error]The operation was canceled.", "github"),
        Stop(
            "##[error]The runner has received a shutdown signal. This can happen when the runner service is stopped, "
            "or a manually started runner is canceled.",
            "github",
        ),
        Stop(
            "##[error]Step canceled by GitHub (see: https://depot.dev/docs/github-actions/troubleshooting#error-step-canceled-by-github)",
            "github",
        ),
    ),
    instances=(
        Instance("line", "Runner name: ", gate="github"),
        Instance("line", "Machine name: ", gate="github"),
        Instance("shape", "productionresultssa{n}.blob.core.windows.net", gate="github"),
        Instance("argument", "##[command]/usr/bin/docker ", ("--name", "--label", "-t"), ("label=",), gate="github"),
    ),
    channels=("annotated", "stripped"),
    revisions=("v1", "v2"),
    echoed_source=lambda raw: bool(_ECHO.match(raw)),
)

_GITLAB_VERDICTS = {"Job succeeded": "SUCCESS", "ERROR: Job failed": "FAILURE", "ERROR: Job failed: canceled": "CANCELLED"}
_GITLAB_PREFIX = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{6}Z [0-9]{2}[OE][ +]")


def _gitlab_claims(line: str) -> bool:
    return bool(_GITLAB_PREFIX.match(line)) or line.startswith(("section_start:", *_GITLAB_VERDICTS))


def _parse_gitlab(line: str) -> Parsed | None:
    """A runner's stamp and stream tag of 32 bytes go; a line that is nothing else, or not the runner's, has no event."""
    if not _gitlab_claims(line):
        return None
    m = _GITLAB_PREFIX.match(line)
    content = line[m.end() :] if m else line
    return Parsed(content, ts_ns=times.iso8601(line[:27]) if m else None, level=infer_level(content)) if content else None


gitlab = Package(
    "gitlab",
    "1.1.0",
    markers=(Marker("section_start:", "Step", extract="numbered", gate="gitlab"),),
    outcome_tokens=_outcomes("gitlab", {"Success": "success", "Failure": "failed", "Cancelled": "canceled", "Unknown": "skipped manual"}),
    outcome_markers=tuple(OutcomeMarker(prefix, "gitlab", outcome) for prefix, outcome in _GITLAB_VERDICTS.items()),
    format=Format("GitLab", lambda line: 0.92 if _gitlab_claims(line) else 0.0, _parse_gitlab),
)

jenkins = Package(
    "jenkins",
    "1.1.0",
    markers=(
        Marker("[Pipeline] { (", "Job", extract="paren", order="Unordered", gate="jenkins"),
        Marker("[Pipeline] ", "Step", extract="rest", gate="jenkins", excludes=("{", "}", "stage", "node", "parallel", "//", "End of Pipeline")),
    ),
    outcome_tokens=_outcomes("jenkins", {"Success": "SUCCESS", "Failure": "FAILURE", "Unstable": "UNSTABLE", "Aborted": "ABORTED", "Unknown": "NOT_BUILT"}),
    outcome_markers=(OutcomeMarker("Finished: ", "jenkins"),),
)

package_managers = Package("package_managers", roles=(Role("Progress: resolved {n}, reused {n}, downloaded {n}, added {n}", "Progress", shape=True),))

version_control = Package(
    "version_control",
    roles=(
        *(Role(f"Updating files:{' ' * n}{{n}}% ({{n}}/{{n}})", "Progress", shape=True) for n in (3, 2, 1)),
        Role("Updating files: {n}% ({n}/{n}), done.", "Progress", shape=True),
    ),
)

test_frameworks = Package(
    "test_frameworks",
    locations=(
        Location("infix", infixes=(".test.", ".spec."), extensions=("ts", "tsx", "js", "jsx", "mjs", "cjs", "py")),
        Location("affix", extensions=(".py",), prefixes=("test_",), suffixes=("_test",)),
        Location("suffix", suffixes=("_test.go", "_spec.rb", "_test.rb")),
    ),
)

PACKAGES = (github, gitlab, jenkins, package_managers, version_control, test_frameworks)


def all_rules() -> Rules:
    return compose(*PACKAGES)


NO_RULES = compose()
