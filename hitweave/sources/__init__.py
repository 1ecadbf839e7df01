"""Sources and derived inputs."""
