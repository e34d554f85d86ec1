"""Part of passagemill."""
