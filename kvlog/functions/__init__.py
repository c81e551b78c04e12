"""Part of kvlog."""
