"""Multi-step jobs: bounded reads, backfill planning, tier refresh, day merge and gap repair."""
