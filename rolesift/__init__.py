"""rolesift: job-posting normalisation, de-duplication and matching on Spark."""
