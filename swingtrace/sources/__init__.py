"""Readers, writers and the adapter from the test tables to the ad-event shape."""
