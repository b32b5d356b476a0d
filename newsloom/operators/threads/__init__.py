"""Event threads: hotness, roll-up, profile, relations, edits, lists."""
