"""Change files arriving over time, applied as table snapshots."""
