"""The sample tables that the tests read."""

SAMPLE = "/root/testdata/sf0.001"
