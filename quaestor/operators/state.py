"""Keyed state machines as pure steps: the learn loop and the token bucket."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

# Burst and refill a second by provider.
BUCKETS = {"gemini": (15.0, 0.25), "groq": (30.0, 0.5)}


@dataclass(frozen=True)
class Policy:
    depth: int = 1
    lesson: str = "cram"


# How deep each mode follows prerequisites.
POLICIES = {"night_before": Policy(1, "cram"), "mastery": Policy(4, "full")}


# Which events spend minutes.
SPENDING = {"LESSON_SERVED", "TEST_PASSED", "TEST_FAILED"}
# Why the session goes on as it does.
REASONS = {
    "empty": "There is nothing left in the plan.", "start": "Starting with the highest-return concept in the plan.", "test": "Now a real past question on this concept, to confirm it landed.",
    "cleared": "Prerequisite cleared. Back to the concept that needed it.", "last": "That was the last concept in the plan.", "broke": "Time is up. Stopping rather than starting something unfinishable.",
    "passed": "Passed. Moving to the next concept by return on time.", "hop": "That answer missed a prerequisite. Teaching it first, then coming back.",
    "cycle": "That prerequisite was already covered in this session.", "deep": "Not going deeper; there is not time to finish the chain.", "none": "No prerequisite explains the gap.", "poor": "Not enough reserve time to finish that repair.",
    "idle": "Nothing is being studied, so there is nothing to escalate.", "stuck": "The lesson did not land, so the tutor takes over from here.", "nowhere": "Nothing left to return to.", "back": "Back from the tutor. Confirming it landed with a real question.",
    "skipped_last": "Skipped, and that was the last concept.", "skipped": "Skipped at your request. Moving on.",
}


@dataclass(frozen=True)
class Session:
    plan: tuple = ()
    budget: float | None = None
    planned: float = 0.0
    reserve: float = 0.0
    state: str = "SELECT"
    index: int = 0
    stack: tuple = ()
    spent: float = 0.0
    current: object = None
    effects: tuple = field(default=())
    reason: str = ""

    @property
    def active(self):
        return self.stack[-1] if self.stack else self.at(self.index)

    def at(self, i: int):
        return self.plan[i] if i < len(self.plan) else None

    @property
    def broke(self) -> bool:
        return self.budget is not None and self.spent >= self.budget

    def to(self, state: str, reason: str, *effects: str, **changes) -> Session:
        return replace(self, state=state, reason=reason, effects=effects, **changes)

    def taught(self, concept, policy: Policy, reason: str, *before: str, **changes) -> Session:
        return self.to("TEACH", reason, *before, f"serve_lesson:{concept}:{policy.lesson}", current=concept, **changes)


def can_absorb(spent: float, planned: float, cost: float, reserve: float) -> bool:
    return max(0.0, spent - planned) + cost <= reserve


def _passed(s: Session, concept, policy: Policy) -> Session:
    done = f"record_mastery:{concept}:true"
    if s.stack:
        s = replace(s, stack=s.stack[:-1])
        if s.active is None:  # the plan has no such place: the lesson ends, the state does not
            return s.to("TEACH", REASONS["cleared"], done, "finish", current=None)
        return s.taught(s.active, policy, REASONS["cleared"], done)
    follows = s.at(s.index + 1)
    if follows is None:
        return s.to("DONE", REASONS["last"], done, "finish", index=s.index + 1, current=None)
    if s.broke:
        return s.to("DONE", REASONS["broke"], done, "finish")
    return s.taught(follows, policy, REASONS["passed"], done, index=s.index + 1)


def _failed(s: Session, concept, target, hop_cost: float, policy: Policy) -> Session:
    done = f"record_mastery:{concept}:false"
    checks = (("cycle", target is not None and target in s.stack), ("deep", len(s.stack) >= policy.depth), ("none", target is None), ("poor", not can_absorb(s.spent, s.planned, hop_cost, s.reserve)))
    refused = next((name for name, hit in checks if hit), None)
    if refused is None:
        return s.taught(target, policy, REASONS["hop"], done, stack=(*s.stack, target))
    follows = s.at(s.index + 1)
    moved = {"index": s.index + 1, "stack": ()}
    if follows is None or s.broke:
        return s.to("DONE", f"{REASONS[refused]} Nothing further fits in the time left.", done, "finish", **moved)
    return s.taught(follows, policy, f"{REASONS[refused]} Moving to the next concept.", done, **moved)


def advance(s: Session, event: str, concept=None, minutes: float = 0.0, missed: tuple = (), hop_cost: float = 10.0, policy: Policy = POLICIES["night_before"]) -> Session:
    """The session after an event, with the effects to carry out in order and the reason. Any event is taken in any state."""
    if event in SPENDING:
        s = replace(s, spent=s.spent + (minutes or 0.0))
    if event == "LESSON_SERVED":
        return s.to("TEST", REASONS["test"], f"serve_test:{concept}")
    if event == "TEST_PASSED":
        return _passed(s, concept, policy)
    if event == "TEST_FAILED":
        return _failed(s, concept, missed[0] if missed else None, hop_cost, policy)
    if event == "ABANDON_CONCEPT":
        follows, moved = s.at(s.index + 1), {"index": s.index + 1, "stack": ()}
        return s.to("DONE", REASONS["skipped_last"], "finish", **moved) if follows is None else s.taught(follows, policy, REASONS["skipped"], **moved)
    nothing = {"START": "empty", "ESCALATE": "idle", "TUTOR_RESOLVED": "nowhere"}
    if event not in nothing:
        raise ValueError(f"unknown event {event}")
    if s.active is None:
        return s.to("DONE", REASONS[nothing[event]], "finish")
    if event == "START":
        return s.taught(s.active, policy, REASONS["start"])
    if event == "ESCALATE":
        return s.to("STUCK", REASONS["stuck"], f"log_escalation:{s.active}:1-2", f"open_tutor:{s.active}")
    return s.to("TEST", REASONS["back"], f"serve_test:{s.active}")


def take(tokens: float, last: float | None, now: float, cost: float, capacity: float, rate: float) -> tuple[float, bool, int]:
    """(tokens left, allowed, whole milliseconds to wait) of a bucket that refills lazily."""
    tokens = capacity if last is None else min(capacity, tokens + max(0.0, now - last) * rate)
    if tokens >= cost:
        return tokens - cost, True, 0
    return tokens, False, math.ceil((cost - tokens) / rate * 1000)
