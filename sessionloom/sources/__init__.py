"""Readers and writers of agent logs and stores."""
