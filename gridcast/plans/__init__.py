"""Multi-step jobs: model fitting, experiments, scoring and the end-to-end runs."""
