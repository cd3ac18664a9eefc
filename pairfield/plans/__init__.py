"""Multi-step plans: temporal inversion, footprints, exports, stacks, resumable runs."""
