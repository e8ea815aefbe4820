"""End-to-end jobs: estimators, model flows, tuning."""
