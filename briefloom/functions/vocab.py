"""The word lists of the extractors, and the patterns generated from them."""

from __future__ import annotations

import re
from itertools import product

# Phrases that mark a sentence or a block.  A trailing * stands for any further letters, + for at least one.
DECISION = ["decided to", "decision:", "final decision", *[f"{a} {b}" for a, b in product(["we'll", "we will", "we should"], ["use", "go with", "adopt", "switch to"])], *[f"{a} {b}" for a, b in product(["let's", "lets"], ["use", "go with", "adopt"])], "going with", "agreed on", "agreed to", "we chose", "settled on"]
REJECTION = ["rejected", "won't use", "wont use", "will not use", "ruled out", "decided against", "dropping", "not going with", "instead of"]
ARCHITECTURE = ["architecture", "service", "microservice", "gateway", "queue", "topic", "database", "schema", "cache", "endpoint", "api", "event", "stream", "partition", "shard", "cluster", "deployment", "container"]
REQUIREMENT = ["must", "must not", "shall", "should", "should not", "is required to", "has to"]
TODO = ["todo", "fixme", "follow-up", "follow up", "still pending", "remaining work", "remains to", "yet to be", "we still need", *[f"{a} to {b}" for a, b in product(["need", "needs"], ["add", "implement", "write", "update", "fix", "migrate", "document", "test"])]]
RISK = ["risk", "risky", "security", "vulnerab+", "injection", "xss", "csrf", "data loss", "race condition", "performance", "latency", "slow", "memory leak", "timeout", "scalab+", "migration", "breaking change", "known issue", "tech debt", "concern", "caveat", "edge case", "backward compat*", "backwards compat*"]
DEPENDENCY = ["depends on", "dependency", "blocked by", "blocked on", "blocker", "waiting on", "waiting for"]
NEEDED_THINGS = ["team", "service", "api", "library", "upgrade", "approval"]
GOAL_SENTENCE = ["so that", "in order to", "business goal", "objective", "the goal is"]
GOAL_BLOCK = [*GOAL_SENTENCE, "customer want", "customers want", "customer need", "customers need", "revenue", "compliance"]
SECTION = ["acceptance criteria", "definition of done", "dod"]
GHERKIN = ["given", "when", "then", "and"]
CONNECTOR_BOTS = ["bot", "jenkins", "automation", "pipeline", "github", "dependabot", "sonar", "bamboo"]
FILTER_BOTS = ["bot", "jenkins", "automation", "pipeline", "github-actions", "dependabot", "sonar"]
GREETINGS = ["hi", "hello", "hey", *[f"{a} {b}" for a, b in product(["hi", "hello", "hey"], ["team", "all", "everyone", "folks", "guys"])], "thanks", "thank you", "thx", "ty", "+1", "lgtm", "ok", "okay", "sounds good", "got it", "noted", "any update", "any update?", "ping", "bump"]
LOG_LEVELS = ["TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL"]

# Weights of the categories and thresholds of the levels.
WEIGHTS = {"DECISION": 0.98, "ACCEPTANCE_CRITERIA": 0.96, "BUSINESS_GOAL": 0.94, "ARCHITECTURE": 0.90, "CONSTRAINT": 0.88, "RISK": 0.85, "DEPENDENCY": 0.82, "TODO": 0.78, "DISCUSSION": 0.50, "NOISE": 0.01}
LEVELS = {"TINY": 0.90, "SMALL": 0.86, "MEDIUM": 0.84, "FULL": 0.0}


def alternation(phrases: list[str]) -> str:
    """Any of the phrases, longer ones first."""
    tails = {"*": r"\w*", "+": r"\w+"}
    one = lambda p: re.escape(p[:-1]).replace(r"\ ", " ") + tails[p[-1]] if p[-1] in tails and p != "+1" else re.escape(p).replace(r"\ ", " ")
    return "(?:" + "|".join(one(p) for p in sorted(phrases, key=lambda p: (-len(p), p))) + ")"


def words(phrases: list[str]) -> str:
    """Any of the phrases as whole words, in any case."""
    return rf"(?i)\b{alternation(phrases)}\b"


#: A dependency may also be a need for a named thing: "requires the Payments team".
DEPENDENCY_PATTERN = rf"(?i)\b(?:{alternation(DEPENDENCY)}|requires? (?:the )?(?:[a-z][\w-]+ )?{alternation(NEEDED_THINGS)})\b"
