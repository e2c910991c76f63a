"""Structured Streaming forms of operators: extensions, since the original only works on finished inputs."""
