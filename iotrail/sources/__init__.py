"""Readers and writers for recordings, decoded trace tables and exports."""
